"""Line dedup, near dedup, decontamination and personal data against plain restatements."""

import hashlib
from pathlib import Path
from urllib.parse import unquote, urlparse

import brute
import numpy as np
import pytest

from kinoflow.llm import common, components, decontaminate, hashing, line_dedup, near_dedup, pii, queries
from kinoflow.llm.perfect_hash import PerfectHash, Shard

LONG = "this is a line of more than forty characters number "
ODD = [
    (1, None), (2, ""), (3, "\n\n"), (4, "one"), (5, "One"), (6, "  one  "), (7, "é" * 50 + "\n" + LONG),
    (8, LONG.upper() + "\t"), (9, LONG + "\n" + LONG + " \nrest"), (10, LONG), (11, LONG), (12, "x " * 3000), (13, "x " * 3000),
    (14, "a@b.co 10.0.0.1 +1 (555) 010-99 99 4111 1111 1111 1111 DE89370400440532013000 é x.y@z.w.v_q@r.s"),
    (15, "1.1.1.1.1.1.1.1 256.1.1.1 000.1.2.3 +12 a+b@c-d.e @x.y a@b 😀 4111-1111-1111-1111 5 55 " * 40),
    (16, "word " * 12 + "end"), (17, "Kelvin K ÀÉ a1 ٣"), (18, "   nbsp em "), (19, "9" * 3000 + "." * 10),
]


def docs(spark, rows, **more):
    schema = "doc_id long, text string" + "".join(f", {k} string" for k in more)
    return spark.createDataFrame([(*r, *more.values()) for r in rows], schema)


@pytest.fixture(scope="module")
def table(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def as_dict(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_near_dedup_table(spark, sf, table):
    got = as_dict(queries.op9_minhash_near_dedup(spark, sf))
    assert got == brute.near_duplicates(table, 2)


@pytest.mark.parametrize("size", [2, 5])
def test_near_dedup_odd(spark, size):
    want = brute.near_duplicates(ODD, size)
    frame = docs(spark, ODD, rep="x", bands="y", component_id="z")
    assert as_dict(near_dedup.near_duplicates(frame, size)) == want


def edited(rng, words, share):
    w = list(words)
    for i in rng.choice(len(w), int(len(w) * share), replace=False):
        w[i] = f"e{rng.integers(1 << 40)}"
    return " ".join(w)


def test_near_dedup_groups(spark):
    """Groups around the threshold, where a bucket's smallest member doesn't link to all others."""
    rng = np.random.default_rng(5)
    rows = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(150)]
        for _ in range(40):
            rows.append((len(rows) + 1, edited(rng, base, rng.uniform(0, 0.09))))
    rows += [(len(rows) + 1 + i, rows[i * 7][1]) for i in range(30)]
    got = as_dict(near_dedup.near_duplicates(docs(spark, rows), 2))
    assert got == brute.near_duplicates(rows, 2)
    assert len({v[1] for v in got.values()}) > 12


def test_near_dedup_nulls_and_repeats(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, "a b c d e f")]
    got = sorted(map(tuple, near_dedup.near_duplicates(docs(spark, rows), 2).collect()), key=str)
    assert got == sorted([(1, 5, 1, True)] * 2 + [(None, 5, None, True), (None, 0, None, True), (2, 5, 1, False)], key=str)
    assert near_dedup.near_duplicates(docs(spark, []).limit(0), 2).count() == 0


def test_near_dedup_rows_of_one_id(spark):
    """An id with two sets joins what both are linked with."""
    one, two, far = "a b c d e f g h", "p q r s t u v w", "k l m n o i j y"
    rows = [(7, one), (7, two), (3, two), (9, one + " z z"), (5, far), (9, one)]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs(spark, rows), 2).collect())
    assert got == [(3, 3, True), (5, 5, True), (7, 3, False), (7, 3, False), (9, 3, False), (9, 3, False)]


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_near_dedup_hot_groups(spark, monkeypatch, few):
    """A bucket and a group that hold most rows go the way of hubs and blocks."""
    monkeypatch.setattr(common, "PLAIN_ROWS", few)
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, edited(rng, base, rng.uniform(0, 0.08))) for i in range(900)]
    rows += [(1000 + i, " ".join(f"x{i}y{j}" for j in range(30))) for i in range(300)]
    assert as_dict(near_dedup.near_duplicates(docs(spark, rows), 2)) == brute.near_duplicates(rows, 2)


def test_kept_tables_have_no_checksum_files(spark):
    """Each such file costs the executor a child process; the checksums in the pages find damage instead."""
    table = common.kept(spark.range(0, 20_000, 1, 2).selectExpr("id", "hash(id) AS x"), "summed")
    folder = Path(unquote(urlparse(table.inputFiles()[0]).path)).parent
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, spark.range(20_000).selectExpr("id", "hash(id) AS x").collect()))
    assert not list(folder.rglob("*.crc"))
    for part in folder.glob("part-*"):
        data = bytearray(part.read_bytes())
        data[len(data) // 2] ^= 1
        part.write_bytes(data)
    with pytest.raises(Exception, match="(?i)crc"):
        spark.read.options(**common.VERIFIED).schema(table.schema).parquet(str(folder)).collect()


def test_block_linker_equals_pairs():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, rng.integers(20, 40))) for _ in range(60)]
    own = rng.random(60) < 0.5
    data = pa.table({"doc_id": pa.array(range(60)), "own": pa.array(own), "kind": pa.array(range(60)), "shingles": pa.array([s.tolist() for s in sets])})
    out = near_dedup.block_linker(60)(data)
    links = list(zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True))
    want = []
    for i in np.flatnonzero(own):
        for j in np.flatnonzero(~own):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 60 * (len(sets[i]) + len(sets[j]) - both):
                want.append((i, j))
    assert set(links) <= set(want) and want
    assert brute.components(range(60), links) == brute.components(range(60), want)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:700], rng.integers(0, 1 << 63, 300).astype(np.uint64)])
    same = np.mean(near_dedup.circulant_signature(a, 2000) == near_dedup.circulant_signature(b, 2000))
    assert abs(same - 700 / 1300) < 0.05


def test_line_dedup_table(spark, sf, table):
    assert as_dict(queries.op10_line_dedup(spark, sf)) == brute.line_dedup(table)


@pytest.mark.parametrize("room", [1 << 26, 0])
def test_line_dedup_odd(spark, room):
    frame = docs(spark, ODD, n_lines="x", keeper="y", shard="z")
    out = line_dedup.dedup_lines(frame, min_docs=3, broadcast_bytes=room, shard_keys=1)
    got = {}
    for r in out.collect():
        got[r["doc_id"]] = (r["n_lines"], r["n_dropped"], hashlib.sha256((r["text"] or "").encode()).hexdigest())
        assert r["keeper"] == "y" and (r["text"] is None) == (r["doc_id"] == 1)
    assert got == brute.line_dedup(ODD, min_docs=3)
    assert sum(v[1] for v in got.values()) > 3


def test_line_dedup_nulls_and_repeats(spark):
    rows = [(None, LONG), (None, LONG), (3, LONG), (3, LONG), (2, LONG)]
    for room in (1 << 26, 0):
        out = line_dedup.dedup_lines(docs(spark, rows), broadcast_bytes=room)
        got = sorted(((r["doc_id"], r["n_dropped"]) for r in out.collect()), key=str)
        assert got == sorted([(None, 1), (None, 1), (3, 0), (3, 0), (2, 1)], key=str)
    assert line_dedup.dedup_lines(docs(spark, [(None, LONG)] * 6)).agg({"n_dropped": "sum"}).first()[0] == 0
    assert line_dedup.dedup_lines(docs(spark, []).limit(0)).count() == 0


CLASH = ["_keys", "_drop", "_mark", "_lost", "_id", "_of", "keys", "drop", "mark", "id", "of", "lost", "KEYS_"]


@pytest.mark.parametrize("room", [1 << 26, 0])
def test_line_dedup_keeps_columns(spark, room):
    """Columns with the names that the operator uses inside come back as they were, on both paths."""
    frame = docs(spark, ODD, **{c: c for c in CLASH})
    out = line_dedup.dedup_lines(frame, min_docs=3, broadcast_bytes=room, shard_keys=2)
    assert out.columns == [*frame.columns, "n_lines", "n_dropped"]
    rows = out.collect()
    assert len(rows) == len(ODD) and all(r[c] == c for r in rows for c in CLASH)


def test_line_counts_decide_at_the_probe(spark):
    """One index, built without a threshold; the counts in it say which lines go."""
    rows = [(i, f"{LONG}{k}") for k in range(2, 9) for i in range(k)]
    shards, n, _ = line_dedup.build_shards(docs(spark, rows), 40, shard_keys=2)
    held = {r["shard"]: Shard.from_bytes(bytes(r["data"])) for r in shards.collect()}
    assert n > 1 and sorted(c for s in held.values() for c in s.counts.tolist()) == list(range(2, 9))
    probe = docs(spark, [(99, "\n".join(f"{LONG}{k}" for k in range(1, 10)))])
    keys = probe.select(line_dedup.line_hashes(probe["text"], 40).alias("k")).first()["k"]
    h, p = (np.array([x[i] for x in keys]) for i in (0, 1))
    for least in (2, 5, 8, 9):
        gone = line_dedup.drops(held, n, h, p, np.full(9, 99), least)
        assert np.flatnonzero(gone).tolist() == [k - 1 for k in range(least, 9)]


def test_perfect_hash():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 50_000).astype(np.uint64))
    at = PerfectHash.build(keys).find(keys)
    assert sorted(at.tolist()) == list(range(len(keys)))
    shard = Shard.build(keys, keys ^ np.uint64(7), np.arange(len(keys)), -np.arange(len(keys)))
    shard = Shard.from_bytes(shard.to_bytes())
    known, count, keeper = shard.probe(keys, keys ^ np.uint64(7))
    assert known.all() and (count == np.arange(len(keys))).all() and (keeper == -np.arange(len(keys))).all()
    assert not shard.probe(keys + np.uint64(1), keys)[0].any()
    assert not Shard.build(*[np.empty(0, np.uint64)] * 2, *[np.empty(0, np.int64)] * 2).probe(keys, keys)[0].any()


def test_decontamination_table(spark, sf, table):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute.contamination(table, items)
    assert as_dict(queries.op3_decontamination(spark, sf)) == want
    assert any(v[4] for v in want.values())


ITEMS = [
    (1, "x x x x x x x x x x x x x x x"), (2, "one"), (3, None), (4, "--"), (5, "word word"), (6, "x X x"), (10, "One"),
    (7, "this is a line of more than forty characters number"), (8, "DE89370400440532013000 é x y z w v q r s"),
]


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_decontamination_odd(spark, few):
    from pyspark.sql import functions as F

    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(1))
    frame = docs(spark, ODD + [(12, "x " * 3000)], win="x", gram="y", item_id="z")
    out = decontaminate.find_contamination(frame, items, broadcast_bytes=few)
    rows = out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256), "contaminated").collect()
    want = brute.contamination(ODD, ITEMS)
    assert len(rows) == len(ODD) + 1
    assert {r[0]: tuple(r)[1:] for r in rows} == want


def test_decontamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.find_contamination(docs(spark, ODD), none).collect()
    assert len(out) == len(ODD) and not any(r["contaminated"] for r in out)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.find_contamination(docs(spark, []).limit(0), items).count() == 0


def test_pii_table(spark, sf, table):
    got = {k: v[:5] for k, v in as_dict(queries.op8_pii(spark, sf)).items()}
    assert got == {d: brute.pii(t)[0] for d, t in table}


def test_pii_odd(spark):
    rows = as_dict(pii.pii_digest(docs(spark, ODD, pii="x", spans="y")))
    for d, t in ODD:
        digest, spans = brute.pii(t)
        assert rows[d][:5] == digest, (d, rows[d], spans)
        assert set(filter(None, spans.split(","))) <= set(rows[d][5].split(","))
    assert "iban:" in rows[14][5]


def test_pii_fuzz(spark):
    rng = np.random.default_rng(7)
    signs = list("0123456789") * 3 + list("..@@++--  ()ab_%é\n") + ["192.168.1.1", "4111111111111111", "+1555", "x@y.z"]
    rows = [(i, "".join(rng.choice(signs, rng.integers(0, 300)))) for i in range(400)]
    rows.append((400, "1.2.3.4 " * 3000))
    got = as_dict(pii.pii_digest(docs(spark, rows)))
    assert {d: v[:5] for d, v in got.items()} == {d: brute.pii(t)[0] for d, t in rows}


def test_pii_context_and_checks(spark):
    text = "iban GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765431; call +1 555 010 9999"
    spans = pii.find_pii(docs(spark, [(1, text)])).first()["pii"]
    assert [(s["kind"], round(s["score"], 2)) for s in spans] == [("iban", 0.9), ("phone", 0.7)]


def test_pii_context_alone_decides(spark):
    """The same span with and without words nearby: they alone add and take away spans, and change scores."""
    iban, key, aba = "DE89370400440532013000", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "021000021"
    texts = {
        1: iban, 2: f"serial {iban}", 3: f"my iban is {iban}, serial", 4: f"{iban} AND 2024", 5: key, 6: f'api_key = "{key}"',
        7: f"commit {key}", 8: f"sha256 key {key}", 9: aba, 10: f"routing number {aba}", 11: "routing number 021000022",
        12: "DNI 12345678Z", 13: "DNI 12345678A", 14: "12345678Z", 15: "assuré 1 85 05 78 006 084 91", 16: "assuré 185057800608492",
        17: "BE68 5390 0754 7034 AND more", 18: "10.0.0.1", 19: "server 10.0.0.1", 20: "version 10.0.0.1", 21: "token " + "a" * 40,
    }
    found = {r["doc_id"]: [(s["kind"], s["score"]) for s in r["pii"]] for r in pii.find_pii(docs(spark, list(texts.items()))).collect()}
    want = {
        1: [("iban", 0.6)], 2: [], 3: [("iban", 0.7)], 4: [("iban", 0.6)], 5: [], 6: [("secret", 0.7)], 7: [], 8: [], 9: [],
        10: [("routing", 0.7)], 11: [], 12: [("dni", 0.8)], 13: [], 14: [], 15: [("nir", 0.8)], 16: [], 17: [("iban", 0.6)],
        18: [("ip", 0.6)], 19: [("ip", 0.7)], 20: [("ip", 0.4)], 21: [],
    }
    assert {k: [x for x in v if x[0] not in ("card", "phone")] for k, v in found.items()} == want


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(common, "PLAIN_ROWS", few)
    rng = np.random.default_rng(4)
    links = [tuple(map(int, rng.integers(0, 300, 2))) for _ in range(220)] + [(i, i + 1) for i in range(400, 500)]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(frame).collect()}
    want = brute.components({x for p in links for x in p}, links)
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in links)}
    assert components.connected_components(frame.limit(0)).count() == 0
    hub = [(0, i) for i in range(1, 500)] + [(i, 1000 + i) for i in range(0, 500, 3)] + [(2000, 2000 + i) for i in range(300)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(hub, "a long, b long")).collect()}
    want = brute.components({x for p in hub for x in p}, hub)
    assert got == want


def test_shingle_hashes():
    got = hashing.word_shingles([b"A b\tc", None, b"", b"a  B c", b"one"], 2, hashing.WordHashes(2))
    assert got[0].tolist() == got[3].tolist() and [len(x) for x in got] == [2, 0, 0, 2, 1]


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_hub_join(spark, monkeypatch, few):
    """Hot, rare, null and unmatched keys, inner and outer, on both sides of the limit."""
    monkeypatch.setattr(common, "PLAIN_ROWS", few)
    keys = [1] * 500 + [2] * 70 + [3] * 5 + [None] * 90 + [9] * 100
    left = spark.createDataFrame(list(enumerate(keys)), "i int, k int")
    right = spark.createDataFrame([(1, 500, "a"), (2, 70, "b"), (3, 5, "c"), (4, 0, "d")], "of int, n int, v string")
    names = {1: "a", 2: "b", 3: "c"}
    for outer in (False, True):
        got = sorted(map(tuple, common.hub_join(left, right, "k", "of", "n", 765, outer).collect()))
        assert got == [(i, k, names.get(k)) for i, k in enumerate(keys) if outer or k in names]


def test_shared_dir(spark):
    assert common.shared_dir(spark) == common.shared_dir(spark)
