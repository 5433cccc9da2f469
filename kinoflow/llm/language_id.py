"""Language identification by Bayesian fusion of text, declared language, address suffix and host priors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinoflow.llm.batches import pieces
from kinoflow.llm.common import kept, let, small_batches, spare
from kinoflow.llm.word_cache import forget

BUCKETS = 1 << 16
#: What an address suffix says.
SUFFIXES = {
    "at": "de", "be": "fr", "de": "de", "ch": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es",
    "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en",
}


def trigram_buckets(data: bytes) -> np.ndarray:
    """A bucket for each run of three bytes, ASCII letters lower-cased and other ASCII signs and digits as a blank."""
    raw = _FOLD[np.frombuffer(data, np.uint8)].astype(np.uint32)
    if len(raw) < 3:
        raw = np.concatenate([raw, np.full(3 - len(raw), 32, np.uint32)])
    code = raw[:-2] * np.uint32(0x1E35A7BD) + raw[1:-1] * np.uint32(0x85EBCA6B) + raw[2:] * np.uint32(0xC2B2AE35)
    return (code >> np.uint32(16)).astype(np.int64)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


#: Nats a trigram by which a text must be nearer to no language than to its best one before that counts.
MARGIN = 0.5


def background(letters: np.ndarray) -> np.ndarray:
    """Probabilities of the buckets for a text in none of the languages: half of it any bucket alike, half bytes in
    the shares of ``letters`` (256 counts) that don't depend on one another."""
    used = np.flatnonzero(_FOLD == np.arange(256))
    share = (letters[used] + 0.5) / (letters[used] + 0.5).sum()
    c = used.astype(np.uint32)
    code = c[:, None, None] * np.uint32(0x1E35A7BD) + c[:, None] * np.uint32(0x85EBCA6B) + c * np.uint32(0xC2B2AE35)
    weights = (share[:, None, None] * share[:, None] * share).ravel()
    alone = np.bincount((code >> np.uint32(16)).astype(np.int64).ravel(), weights=weights, minlength=BUCKETS)
    return 0.5 / BUCKETS + 0.5 * alone


@dataclass(frozen=True)
class LanguageModel:
    """``table``: (BUCKETS, languages + 1) log probabilities, smoothed; the last column is of none of the languages."""

    languages: tuple[str, ...]
    table: np.ndarray


def fit(
    docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = 1500
) -> LanguageModel:
    """Fits byte-trigram likelihoods on a sample of labelled rows: about ``sample`` documents of each language, whole,
    chosen by a hash of their id, for every language that a label names. Trigrams are counted in the cluster; at
    most BUCKETS * languages sums come to the driver, and the model takes 512 KB a language. Rows with a null text, id
    or language aren't used. Bytes are counted too, for :func:`background`, of which MARGIN is taken off.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = rows.where("lang is not null").groupBy("lang").count().collect()
    if not counts:
        return LanguageModel((), np.zeros((BUCKETS, 1)))
    languages = tuple(sorted(r["lang"] for r in counts))
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], sample / r["count"]).otherwise(share)
    chosen = rows.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)))
    number = {x: i for i, x in enumerate(languages)}

    def count(batches):
        forget()
        sums = np.zeros((len(languages) + 1, BUCKETS), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if lang in number:
                    data = text.encode()
                    sums[number[lang]] += np.bincount(trigram_buckets(data), minlength=BUCKETS)
                    sums[-1, :256] += np.bincount(_FOLD[np.frombuffer(data, np.uint8)], minlength=256)
        at, bucket = np.nonzero(sums)
        yield pa.record_batch({"lang": pa.array(at, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "n": sums[at, bucket]})

    sums = np.zeros((BUCKETS, len(languages) + 1))
    found = chosen.select("lang", "text").mapInArrow(count, "lang int, bucket int, n long")
    got = found.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    sums[got["bucket"].to_numpy(), got["lang"].to_numpy()] = got["n"].to_numpy()
    none, sums = background(sums[:256, -1]), sums[:, :-1]
    # As many trigrams of the background as a language has different ones: what no sample holds is never likelier in a
    # language than in none, however small the sample.
    extra = np.maximum((sums > 0).sum(axis=0), 1)
    smooth = (sums + extra * none[:, None]) / (sums.sum(axis=0) + extra)
    return LanguageModel(languages, np.column_stack([np.log(smooth), np.log(none) - MARGIN]))


def scorer(model: LanguageModel, most: float = 128.0, temper: float = 0.5):
    """Log likelihoods of each text by language, and of none of them. Trigrams overlap and repeat, so a text counts as ``temper`` times its
    number of trigrams, at most ``most``. A null text, or one without letters, says nothing: zeros."""
    table, blank = model.table.astype(np.float32), int(trigram_buckets(b"   ")[0])
    begun: list[bool] = []

    @F.arrow_udf("array<double>")
    def score(text: pa.Array) -> pa.Array:
        if not begun:
            begun.append(True)
            forget()
        out = np.zeros((len(text), table.shape[1]))
        data = text.cast(pa.large_binary())
        for a, b in pieces(data):
            for i, t in enumerate(data.slice(a, b - a).to_pylist(), a):
                if t and (n := len(at := (x := trigram_buckets(t))[x != blank])):
                    total = sum(table[at[k : k + (1 << 16)]].sum(axis=0, dtype=np.float64) for k in range(0, n, 1 << 16))
                    out[i] = total / n * min(n * temper, most)
        flat = pa.array(out.reshape(-1))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1, dtype=np.int32) * out.shape[1]), flat)

    return score


def softmax(logs: Column) -> Column:
    shifted = let(F.array_max(logs), lambda top: F.transform(logs, lambda x: F.exp(x - top)))
    return let(shifted, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))


def _says(tag: Column, languages: tuple[str, ...], trust: float) -> Column:
    """Log likelihoods of a declaration that is right with probability ``trust``, the last that of none of the
    languages; unknown or null tags say nothing."""
    n = len(languages)
    miss = float(np.log((1 - trust) / max(n - 1, 1))) if n > 1 else 0.0
    each = F.array(*[F.when(tag == x, float(np.log(trust))).otherwise(miss) for x in languages], F.lit(miss))
    return F.when(tag.isin(*languages), each).otherwise(F.array(*[F.lit(0.0)] * (n + 1)))


def markup_language(text: Column) -> Column:
    """The language that a page's root element declares, without a region; null where it declares none."""
    root = F.when(F.contains(text, F.lit("<")), F.regexp_extract(text, r"(?i)<html\b[^>]*+", 0))
    lang = F.regexp_extract(root, r"(?i)\blang\s*+=\s*+[\"']?([a-z]{2,3})", 1)
    return F.lower(F.nullif(lang, F.lit("")))


def visible(text: Column) -> Column:
    """A text without tags, where it is a page."""
    page = F.contains(text, F.lit("<")) & F.regexp_like(text, F.lit(r"(?i)<html\b"))
    return F.when(page, F.regexp_replace(text, "<[^>]*>", " ")).otherwise(text)


def host_levels(host: Column) -> tuple[Column, Column]:
    """(domain, suffix) of a host: its last two labels, and the last. Names without a dot have neither: null."""
    parts = F.split(F.lower(host), r"\.")
    dotted = F.contains(host, F.lit("."))
    return F.when(dotted, F.substring_index(F.lower(host), ".", -2)), F.when(dotted, F.element_at(parts, -1))


def identify(
    docs: DataFrame,
    model: LanguageModel,
    text_col: str = "text",
    declared_col: str | None = None,
    host_col: str | None = None,
    accept: tuple[str, ...] | None = None,
    least: float = 0.5,
    trust: float = 0.9,
    suffix_trust: float = 0.6,
    strength: float = 20.0,
    broadcast_bytes: int = 64 << 20,
    unknown: float = 0.05,
) -> DataFrame:
    """Adds language, probability, text_language, and accepted.

    posterior ~ text likelihood * declared language * address suffix * host prior. The declared language is the
    column's, else the one in the text's HTML root. Host priors come from one grouped aggregation of text posteriors,
    summed by host before the shuffle, and are smoothed down a hierarchy: all, suffix, domain, host, each with
    ``strength`` rows of its parent's prior (a host without a dot hangs on all directly); a row's own posterior is taken out of its host's sum; a host without any text has its parent's prior. Host sums are
    broadcast up to ``broadcast_bytes`` of them, else joined by a shuffle that adaptive execution splits at hot hosts.

    Beside the languages stands the hypothesis that a text is in none of them, with a prior of ``unknown`` and the
    likelihood of :func:`background`. Its part of the posterior lowers ``probability`` and goes to no host's sums, so
    texts in other languages and random letters are rejected; text_language is null where it is the likeliest.

    accepted: some text, a probability of at least ``least``, and, if given, a language in ``accept``.

    Pages' tags aren't read as text. Null or empty text, or one without letters: the other evidence decides; not accepted. Null host: the prior of all
    rows. Null or unknown declared languages say nothing. Ties: the first language by name. Repeated rows: each is
    judged, and counts for its host. A model without languages: null, 0 and not accepted. Empty table: no rows. All
    other columns stay, whatever their names; columns of the added names are replaced.
    """
    languages, n = model.languages, len(model.languages)
    added = ("language", "probability", "text_language", "accepted")
    names = [c for c in docs.columns if c not in added]
    if not n:
        return docs.select(*names, F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("probability"),
                           F.lit(None).cast("string").alias("text_language"), F.lit(False).alias("accepted"))
    small_batches(docs.sparkSession)
    # A filter on what is added would go below it with a copy of the scoring: each text scored twice, by two workers a task.
    score = scorer(model).asNondeterministic()
    text = F.col(text_col)
    ll, post, key, final, host_of, own_of, domain_of = spare(docs.columns, "ll", "post", "key", "final", "h", "own", "p_domain")
    rows = docs.select(*names).withColumn(ll, score(visible(text))).withColumn(post, F.slice(softmax_of(F.col(ll)), 1, n))
    host = F.col(host_col) if host_col else F.lit(None).cast("string")
    domain, suffix = host_levels(host)
    rows = rows.withColumn(key, F.lower(host))

    seen = F.exists(ll, lambda x: x != 0)
    sums = [F.sum(F.when(seen, F.get(post, F.lit(i))).otherwise(0.0)).alias(f"s{i}") for i in range(n)]
    by_host = rows.groupBy(F.col(key).alias("_host")).agg(*sums)
    of_host, of_suffix = host_levels(F.col("_host"))
    by_host = by_host.withColumns({"_domain": of_host, "_suffix": of_suffix})
    by_host = kept(by_host, "host-sums")
    whole = [F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]
    total = by_host.agg(*whole).first()
    prior = np.array([(total[i] or 0.0) + 1.0 for i in range(n)])
    prior /= prior.sum()

    def smoothed(prefix: str, parent: Column) -> Column:
        own = F.array(*[F.col(f"{prefix}{i}") for i in range(n)])
        size = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(own, parent, lambda s, p: (s + strength * p) / (size + strength))

    every = F.array(*[F.lit(float(p)) for p in prior])
    suffixes = by_host.groupBy("_suffix").agg(*whole).select(
        F.col("_suffix").alias("x"), smoothed("s", every).alias("p_suffix")
    )
    domains = by_host.groupBy("_domain").agg(F.first("_suffix").alias("_suffix"), *whole)
    domains = domains.where("_domain is not null").join(suffixes, F.col("_suffix") == F.col("x")).select(
        F.col("_domain").alias("d"), smoothed("s", F.col("p_suffix")).alias("p_domain")
    )
    hosts = by_host.where("_host is not null").join(domains, F.col("_domain") == F.col("d"), "left").select(
        F.col("_host").alias(host_of),
        F.array(*[F.col(f"s{i}") for i in range(n)]).alias(own_of),
        F.coalesce("p_domain", every).alias(domain_of),
    )
    hosts = kept(hosts, "host-priors")
    size = hosts.agg(F.sum(F.octet_length(host_of) + 16 * n + 64)).first()[0] or 0
    hosts = F.broadcast(hosts) if size <= broadcast_bytes else hosts
    rows = rows.join(hosts, F.col(key) == F.col(host_of), "left")
    others = F.zip_with(own_of, post, lambda s, p: F.greatest(s - F.when(seen, p).otherwise(0.0), F.lit(0.0)))
    at_host = let(
        others,
        lambda o: let(
            F.aggregate(o, F.lit(0.0), lambda a, x: a + x),
            lambda size: F.zip_with(o, F.col(domain_of), lambda s, p: (s + strength * p) / (size + strength)),
        ),
    )
    log_prior = F.concat(
        F.transform(F.coalesce(F.when(F.col(host_of).isNotNull(), at_host), every), lambda p: F.log(p * (1 - unknown))),
        F.array(F.lit(float(np.log(unknown)))),
    )

    declared = F.lower(F.substring_index(F.col(declared_col), "-", 1)) if declared_col else F.lit(None).cast("string")
    declared = F.coalesce(declared, markup_language(text))
    from_suffix = F.lit(None).cast("string")
    for ending, lang in SUFFIXES.items():
        from_suffix = F.when(suffix == ending, lang).otherwise(from_suffix)
    parts = F.arrays_zip(
        F.col(ll).alias("a"), log_prior.alias("b"), _says(declared, languages, trust).alias("c"),
        _says(from_suffix, languages, suffix_trust).alias("d"),
    )
    fused = softmax_of(F.transform(parts, lambda x: x["a"] + x["b"] + x["c"] + x["d"]))
    names_of = F.array(*[F.lit(x) for x in languages])
    rows = rows.withColumn(final, F.slice(fused, 1, n))
    best = F.array_max(final)
    first = lambda c: F.get(names_of, F.array_position(c, F.array_max(c)).cast("int") - 1)
    language, probability = first(F.col(final)), F.round(best, 6)
    ok = seen & (best >= least)
    if accept is not None:
        ok = ok & language.isin(*accept)
    return rows.select(
        *names,
        language.alias("language"),
        probability.alias("probability"),
        F.when(seen, first(F.col(ll))).alias("text_language"),
        ok.alias("accepted"),
    )


def softmax_of(logs: Column) -> Column:
    return let(logs, softmax)
