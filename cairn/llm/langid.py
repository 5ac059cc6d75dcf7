"""Language identification by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import ship, small, written

#: Cells for hashed byte trigrams.
CELLS = 4096
#: Overlapping trigrams are not independent: a text counts as this many at most.
TRIGRAMS = 100
#: All declared languages are known.  A text of none of them is meant to be UNKNOWN, whose trigrams are all alike.
UNKNOWN = "und"
#: More declared languages than there are names of languages are an error: the column holds something else.
MOST_LANGUAGES = 8192
#: Numbers in a lookup table of posteriors that is broadcast: 16 MB.
LOOKUP = 2_000_000
#: Pseudo-counts that pull a host to its domain, a domain to its suffix, and a suffix to the whole.
PULL = 20.0
#: A row is accepted if its best language has at least this posterior and its text has a letter trigram.
ACCEPT = 0.5

_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True


def of_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with the evidence columns _text, _declared, _suffix, _host, _domain: the language column is the declared language, the source the host."""
    columns = docs.columns
    pick = lambda name: F.nullif(F.lower(F.trim(F.col(name).cast("string"))), F.lit("")) if name in columns else F.lit(None).cast("string")
    none = F.lit(None).cast("string")
    return docs.select("*", F.coalesce("text", F.lit("")).alias("_text"), pick("lang").alias("_declared"), none.alias("_suffix"), pick("source").alias("_host"), none.alias("_domain"))


def of_pages(pages: DataFrame) -> DataFrame:
    """``pages`` with the evidence columns, from url and html."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    text = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>", " ")
    part = lambda x: F.nullif(F.lower(x), F.lit(""))
    host = F.regexp_extract(url, r"^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return pages.select(
        "*",
        text.alias("_text"),
        part(F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]+)", 1)).alias("_declared"),
        part(F.regexp_extract(host, r"\.([^.]+)$", 1)).alias("_suffix"),
        part(host).alias("_host"),
        part(domain).alias("_domain"),
    )


def _pieces(column: pa.Array):
    """Counts of trigrams of letters for runs of at most 400 texts: (texts, CELLS)."""
    for batch in tx.slices(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), size=1 << 20):
        for at in range(0, batch.num_rows, 400):
            data, off = tx.raw(batch.column(0).slice(at, 400))
            data = tx.LOWER[data]
            data = np.where(_LETTER[data], data, np.uint8(32)).astype(np.uint32)
            n = len(off) - 1
            if len(data) < 3:
                yield np.zeros((n, CELLS), np.int64)
                continue
            code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
            cell = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
            doc = np.repeat(np.arange(n), np.diff(off))[:-2]
            ok = (doc == np.repeat(np.arange(n), np.diff(off))[2:]) & ((data[:-2] != 32) | (data[1:-1] != 32)) & ((data[1:-1] != 32) | (data[2:] != 32))
            yield np.bincount(doc[ok] * CELLS + cell[ok], minlength=n * CELLS).reshape(n, CELLS)


def languages(rows: DataFrame) -> list[str]:
    """The declared languages in alphabetical order, and last UNKNOWN; none if no row declares one."""
    said = rows.where(F.col("_declared").isNotNull() & (F.col("_declared") != UNKNOWN)).select("_declared").distinct()
    found = sorted(r["_declared"] for r in said.limit(MOST_LANGUAGES + 1).collect())
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} declared languages")
    return [*found, UNKNOWN] if found else []


def text_model(rows: DataFrame, known: list[str]) -> np.ndarray:
    """Log-likelihood of each trigram cell in each language, from grouped counts over all rows that declare one; the same for each cell if unknown."""
    size = len(known) - 1

    def run(batches):
        sums = np.zeros((size, CELLS), np.int64)
        for b in batches:
            label = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            for counts in _pieces(b.column(1)):
                part = label[at : at + len(counts)]
                for k in np.unique(part):
                    sums[k] += counts[part == k].sum(axis=0)
                at += len(counts)
        lang, cell = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int64()), pa.array(cell, pa.int64()), pa.array(sums[lang, cell])], names=["lang", "cell", "n"])

    ship(rows.sparkSession)
    label = F.array_position(F.array(*[F.lit(x) for x in known[:size]]), F.col("_declared")) - 1
    parts = rows.select(label.alias("label"), "_text").where("label >= 0").mapInArrow(run, "lang long, cell long, n long")
    found = parts.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()  # languages times cells at most
    counts = np.zeros((size, CELLS))
    counts[found["lang"].to_numpy(np.int64), found["cell"].to_numpy(np.int64)] = found["n"]
    counts += 0.5
    return np.append(np.log(counts / counts.sum(axis=1, keepdims=True)).T, np.full((CELLS, 1), -np.log(CELLS)), axis=1)


def scores(model: np.ndarray) -> Column:
    """Tempered log-likelihoods of _text, one for each language, and last the number of its trigrams."""

    def run(column: pa.Array) -> pa.Array:
        out = []
        for counts in _pieces(column):
            n = counts.sum(axis=1)
            ll = counts @ model * (np.minimum(n, TRIGRAMS) / np.maximum(n, 1))[:, None]
            out.append(np.concatenate([ll, n[:, None]], axis=1))
        flat = np.concatenate(out).reshape(-1) if out else np.zeros(0)
        width = model.shape[1] + 1
        return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * width), pa.array(flat))

    return F.arrow_udf(run, "array<double>")(F.col("_text"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _softmax(x: Column) -> Column:
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    shifted = lambda v: _let(F.array_max(v), lambda top: F.transform(v, lambda y: F.exp(y - top)))
    return _let(x, lambda v: _let(shifted(v), lambda e: _let(total(e), lambda t: F.transform(e, lambda y: y / t))))


class Evidence:
    """What a scored table says of declared languages, suffixes, domains and hosts: grouped sums of text posteriors."""

    def __init__(self, scored: DataFrame, known: list[str]):
        self.known, size = known, len(known)
        post = scored.where(F.get("_ll", F.lit(size)) > 0).select("_declared", "_suffix", "_domain", "_host", _softmax(F.slice("_ll", 1, size)).alias("p"))
        sums = lambda by, *more: post.groupBy(by).agg(F.array(*[F.sum(F.get("p", F.lit(k))) for k in range(size)]).alias("n"), *more)
        plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
        flat = F.array(*[F.lit(1.0 / size)] * size)
        pulled = lambda n, prior: F.transform(F.zip_with(n, prior, lambda x, y: x + PULL * y), lambda v: v / (total(n) + PULL))
        whole = post.agg(F.array(*[F.coalesce(F.sum(F.get("p", F.lit(k))), F.lit(0.0)) for k in range(size)]).alias("n")).select(pulled(F.col("n"), flat).alias("prior")).first()["prior"]
        self.whole = F.array(*[F.lit(float(x)) for x in whole])
        self.uniform = flat

        # how likely a declared language is, given the true one
        said = written(sums("_declared").where("_declared IS NOT NULL"), "declared")
        every = said.select(F.posexplode("n")).groupBy("pos").agg(F.sum("col").alias("s"))
        column = {r["pos"]: r["s"] for r in every.collect()}
        per = F.array(*[F.lit(float(column.get(k, 0.0))) for k in range(size)])
        likely = F.zip_with("n", per, lambda x, s: F.log((x + 0.5) / (s + 0.5 * (size + 1))))
        self.declared = written(said.select(F.col("_declared").alias("_k1"), likely.alias("_declared_ll")), "declared")

        suffix = written(sums("_suffix").where("_suffix IS NOT NULL").select("_suffix", pulled(F.col("n"), self.whole).alias("sp")), "suffix")
        self.suffix = suffix
        domain = sums("_domain", F.max("_suffix").alias("_suffix")).where("_domain IS NOT NULL").join(suffix, "_suffix", "left")
        domain = written(domain.select("_domain", pulled(F.col("n"), F.coalesce("sp", self.whole)).alias("dp")), "domains")
        # all rows of a host count, those without a domain too; the domain is that of the others
        host = sums("_host", F.max("_domain").alias("_domain")).where("_host IS NOT NULL").join(domain, "_domain", "left")
        host = host.select("_host", F.col("n").alias("_n"), F.coalesce("dp", self.whole).alias("_base"))
        self.host = written(host.select(F.col("_host").alias("_k2"), "_n", "_base"), "hosts")

    def fused(self, scored: DataFrame) -> DataFrame:
        """``scored`` with text_lang, language, probability and accepted.

        The host's prior leaves out the row itself; where the host is unknown,
        the suffix's or the whole table's prior stands in.
        """
        size = len(self.known)
        names = F.array(*[F.lit(x) for x in self.known])
        ll = F.slice("_ll", 1, size)
        few = LOOKUP // (2 * size)
        rows = scored.join(small(self.declared, few), F.col("_declared") == F.col("_k1"), "left")
        spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64("_ll"), F.lit(1000)).cast("string"))  # rows without a host meet none, in many tasks
        rows = rows.join(small(self.host, few), F.coalesce("_host", spread) == F.col("_k2"), "left")
        rows = rows.join(small(self.suffix.withColumnRenamed("_suffix", "_k3"), few), F.col("_suffix") == F.col("_k3"), "left")
        rows = rows.withColumn("_own", _softmax(ll))
        own = F.when(F.get("_ll", F.lit(size)) > 0, F.col("_own")).otherwise(F.transform("_own", lambda v: v * 0))
        others = F.zip_with("_n", own, lambda x, y: F.greatest(x - y, F.lit(0.0)))
        host = F.zip_with(others, "_base", lambda x, y: F.log(x + PULL * y))
        prior = F.coalesce(host, F.transform(F.coalesce("sp", self.whole), lambda v: F.log(v)))
        joint = F.zip_with(F.zip_with(ll, prior, lambda x, y: x + y), F.coalesce("_declared_ll", F.transform(ll, lambda v: v * 0)), lambda x, y: x + y)
        best = lambda v: F.struct(F.array_max(v).alias("p"), F.array_position(v, F.array_max(v)).cast("int").alias("at"))
        rows = rows.withColumn("_best", _let(_softmax(joint), best)).withColumn("_text_best", _let(ll, best)["at"])
        rows = rows.withColumn("probability", F.col("_best.p")).withColumn("language", F.get(names, F.col("_best.at") - 1)).withColumn("text_lang", F.when(F.get("_ll", F.lit(size)) > 0, F.get(names, F.col("_text_best") - 1)))
        accepted = (F.col("probability") >= ACCEPT) & (F.get("_ll", F.lit(size)) > 0) & (F.col("language") != UNKNOWN)
        return rows.withColumn("accepted", accepted)


def identified(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Language of each row that has the evidence columns: ``keep`` of its own columns, then declared, text_lang, language, probability, accepted.

    A language is known if a row declares it; a text that is like none of them
    is likely UNKNOWN, which is never accepted.  The model holds 4,096 numbers
    for each language, and a row's likelihoods one.  Null or empty texts, and texts without letters,
    are not accepted either; their language is what the other evidence says.
    Null declared languages, suffixes and hosts are no evidence.  Ties go to
    the language that comes first in the alphabet, UNKNOWN last.  Repeated rows
    and ids are rows like others, and an empty table gives none.  If no row
    declares a language, none is known: language is null, nothing accepted.

    Plan: a pass for trigram counts by declared language, one that writes each
    row's likelihoods, grouped sums over those; the sums by host are joined by
    broadcast if they are few, by shuffle otherwise.  Texts are not shuffled.
    """
    known = languages(rows)
    if not known:
        return rows.select(*keep, F.col("_declared").alias("declared"), *[F.lit(None).cast(t).alias(n) for n, t in (("text_lang", "string"), ("language", "string"), ("probability", "double"))], F.lit(False).alias("accepted"))
    model = text_model(rows, known)
    scored = written(rows.select(F.struct(*keep).alias("row"), "_declared", "_suffix", "_domain", "_host", scores(model).alias("_ll")), "scored")
    out = Evidence(scored, known).fused(scored)
    return out.select("row.*", F.col("_declared").alias("declared"), "text_lang", "language", "probability", "accepted")


def identified_tables(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Languages of documents (doc_id) and web pages (page_id) together; the other id is null."""
    none = lambda n: F.lit(None).cast("long").alias(n)
    evidence = ["_text", "_declared", "_suffix", "_host", "_domain"]
    a = of_documents(docs.select("doc_id", *_evidence(docs))).select("doc_id", none("page_id"), *evidence)
    b = of_pages(pages.select("page_id", "url", "html")).select(none("doc_id"), "page_id", *evidence)
    return identified(a.unionByName(b), ["doc_id", "page_id"])


def _evidence(docs: DataFrame) -> list[str]:
    return [c for c in ("text", "lang", "source") if c in docs.columns]


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The documents whose language is accepted; all columns of ``docs``, whatever their names, unchanged.

    Nulls, empty texts, ties, repeated rows and unknown languages are as for
    ``identified``; an empty table, or one that declares no language, gives no
    rows.  The scored documents are written once, so a text goes to Python once
    for the model and once for its likelihoods; beyond LOOKUP numbers the
    hosts are joined by shuffle, texts included.
    """
    rows = of_documents(docs.select(F.struct("*").alias("row"), *_evidence(docs)))
    known = languages(rows)
    if not known:
        return docs.limit(0)
    model = text_model(rows, known)
    scored = written(rows.select("row", "_declared", "_suffix", "_domain", "_host", scores(model).alias("_ll")), "scored")
    return Evidence(scored, known).fused(scored).where("accepted").select("row.*")
