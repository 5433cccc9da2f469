"""The corpus pipeline against plain restatements of its stages."""

import brute
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, sf):
    from kinoflow.llm import language_id, sentencepiece_viterbi
    from kinoflow.llm.queries import tokenizer_file

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    table = docs.collect()
    judged = brute.language_posteriors([(r["text"], r["source"], None) for r in table], language_id.fit(docs), language_id.SUFFIXES)
    rows = {r["doc_id"]: r["text"] for r, (x, p, _, seen) in zip(table, judged, strict=True) if seen and p >= 0.5 and x in corpus_pipeline.LANGUAGES}
    assert len(rows) > 0.97 * docs.count()
    # lines
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(brute.LOWER)
    digests = brute.line_dedup(rows.items())
    holders = {}
    for d, t in rows.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders.setdefault(key(x), set()).add(d)
    common = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    rows = {d: "\n".join(x for x in t.split("\n") if common.get(key(x), d) == d) for d, t in rows.items()}
    assert any(v[1] for v in digests.values())
    # near copies
    near = brute.near_duplicates(list(rows.items()), 5)
    rows = {d: t for d, t in rows.items() if near[d][2]}
    # benchmark
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = brute.contamination(rows.items(), items)
    rows = {d: t for d, t in rows.items() if not bad[d][1]}
    encoder = sentencepiece_viterbi.Encoder(sentencepiece_viterbi.Pieces.load(tokenizer_file("piece_bpe_32k.model")))
    flat, counts = encoder.encode([t.encode() for t in rows.values()])
    want, at = {}, 0
    for d, n in zip(rows, counts.tolist(), strict=True):
        want[d] = flat[at : at + n].tolist()
        at += n
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"]: r["ids"] for r in out} == want
    assert all(r["exact"] for r in out)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone string, several string, keys string"


def rows_of(spark, rows):
    return spark.createDataFrame([(d, t, "en", "src1", len(t or ""), "a", "b", "c") for d, t in rows], SCHEMA)


def texts(df):
    assert df.columns[:5] == corpus_pipeline.COLUMNS and len(df.columns) == 5
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_language_stage_rejects(spark, sf):
    """Other languages, letterless, empty and null texts go; repeated rows and very long ones stay."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = docs.where("lang = 'en' and n_chars > 400").first()["text"]
    odd = [(-1, None), (-2, ""), (-3, "12 !!"), (-4, "北京是中华人民共和国的首都，也是全国的政治和文化中心。"), (-5, good), (-5, good), (-6, f"{good} " * 200)]
    both = docs.unionByName(rows_of(spark, odd).select(docs.columns))
    out = corpus_pipeline.keep_languages(spark, both, sf)
    assert sorted(r["doc_id"] for r in out.where("doc_id < 0").collect()) == [-6, -5, -5]


def test_language_stage_scores_once(spark, sf):
    """Host sums are written by then, so one scoring is left: a second one doubles the Python workers beside an executor."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = corpus_pipeline.keep_languages(spark, docs, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_line_stage_odd(spark, sf):
    line = "a line of more than forty characters that many hold"
    rows = [(i, f"{line}\nown {i}") for i in range(5)] + [(7, None), (8, ""), (9, line), (9, line), (None, f"{line}\nx"), (3, "z" * 100_000)]
    got = texts(corpus_pipeline.drop_repeated_lines(spark, rows_of(spark, rows), sf))
    want = [(i, f"own {i}") for i in range(5)] + [(7, None), (8, ""), (9, line), (9, line), (None, "x"), (3, "z" * 100_000)]
    assert got == sorted(want, key=str)


def test_near_copy_stage_odd(spark, sf):
    """One row of each group, also of repeated ids; wordless texts and null ids stay."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(7, base), (7, base), (7, f"{base} more"), (3, f"{base} end"), (9, base), (5, "p q r s t u"), (5, "p q r s t u"), (5, "a b c d e f")]
    rows += [(1, None), (1, None), (2, ""), (2, " \n"), (None, base), (None, base), (11, "long " * 50_000), (12, "long " * 40_000)]
    got = texts(corpus_pipeline.keep_one_of_near_copies(spark, rows_of(spark, rows), sf))
    want = [(3, f"{base} end"), (5, "a b c d e f"), (1, None), (1, None), (2, ""), (2, " \n"), (None, base), (None, base), (11, "long " * 50_000)]
    assert got == sorted(want, key=str)


def test_benchmark_stage_drops_any_passage(spark, sf):
    """A passage of 13 words in a long document counts as much as in a short one; twelve of them don't."""
    item = next(t for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if len(t := r["text"].split()) > 20)
    passage, short = " ".join(item[:13]), " ".join(item[:12])
    filler = " ".join(f"filler{i}" for i in range(3000))
    rows = [(1, f"{filler} {passage} {filler}"), (2, f"{filler} {short} {filler}"), (3, passage), (4, None), (5, ""), (6, f"x {passage}"), (6, "x"), (None, passage)]
    got = texts(corpus_pipeline.drop_benchmark_copies(spark, rows_of(spark, rows), sf))
    assert [d for d, _ in got] == [2, 4, 5, None]


def test_encode_stage_odd(spark, sf):
    rows = [(1, None), (2, ""), (3, "x" * 20_000), (3, "x" * 20_000), (None, "a b"), (4, "é 🙂")]
    out = corpus_pipeline.encode_pieces(spark, rows_of(spark, rows), sf).collect()
    assert len(out) == len(rows) and all(r["exact"] and r["n_pieces"] == len(r["ids"] or []) for r in out)


def test_stages_of_an_empty_table(spark, sf):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows_of(spark, [(1, "a")]).limit(0), sf).count() == 0


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
