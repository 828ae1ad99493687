"""Language identification by Bayesian fusion of evidence.

What a text's byte trigrams say, the language that the markup declares, the language that the
address hints at (a path beginning with a code, else the end of the host name) and the languages
usual at the host are combined into one posterior per language.

* Trigram likelihoods are fitted on at most ``SAMPLE`` labelled documents; longer texts weigh
  more, up to ``TEXT_WEIGHT`` trigrams' worth, as neighbouring trigrams repeat each other.
* How far declarations and addresses can be trusted is estimated from all rows: per declared
  value, the share of each language by text.
* Host priors are grouped sums of the text evidence, smoothed by those of the host's domain,
  which are smoothed by those of all rows.  Sums are pre-aggregated, so a host with a third of
  all rows is one record per task; tables of hosts are joined, not collected.

Pages bring all kinds of evidence; documents bring text and take their source as host.  Null or
empty texts, hosts, declarations and addresses are no evidence and say nothing.  Null and
repeated ids are carried along.  Without labelled documents the language is null.  Empty tables
give empty results.  Other columns are not read.
"""

from __future__ import annotations

import html as markup
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamquarry.llm.ngram_filter import held_out
from streamquarry.llm.rows import stored
from streamquarry.llm.textarrays import mix, pieces

SAMPLE = 4096  # labelled documents the trigrams are fitted on, at most
TABLE_BITS = 16
TEXT_WEIGHT = 40.0
SMOOTH = 20.0  # rows' worth of the wider prior in a narrower one

_opening = re.compile(r"(?i)<(?:!--|(?P<script>script)\b|(?P<style>style)\b|(?P<nav>nav)\b)")
_closing = {None: re.compile("-->")} | {
    name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style", "nav")}
_tag = re.compile(r"<[^>]*>")


def _shown(page: str) -> str:
    """``page`` with a blank for each comment, script, style and navigation that is closed.

    What has no closing behind it is looked for once, so the time is linear in the page.
    """
    kept, start, at, unclosed = [], 0, 0, set()
    while opening := _opening.search(page, at):
        at, kind = opening.end(), opening.lastgroup
        closing = None if kind in unclosed else _closing[kind].search(page, at)
        if closing is None:
            unclosed.add(kind)
            continue
        kept += [page[start:opening.start()], " "]
        start = at = closing.end()
    return "".join([*kept, page[start:]])


def visible_text(page: str) -> str:
    """Text of a page without scripts, styles, navigation, comments and tags."""
    shown = _shown(page)
    last = shown.rfind(">") + 1  # no tag ends behind it
    return markup.unescape(_tag.sub(" ", shown[:last]) + shown[last:])


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table places of the trigrams inside each text, and where each text's begin."""
    n = len(data)
    if n < 3:
        return np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    lower = data + (((data >= 65) & (data <= 90)) * np.uint8(32))
    b = lower.astype(np.uint64)
    at = (mix((b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    inside = np.ones(n - 2, dtype=bool)
    for edge in (offsets[1:-1] - 1, offsets[1:-1] - 2):
        inside[edge[(edge >= 0) & (edge < n - 2)]] = False
    return at[inside], np.concatenate([[0], np.cumsum(inside)])[np.minimum(offsets, n - 2)]


def _counter(n_languages: int):
    def rows(batches):
        counts = np.zeros((n_languages, 1 << TABLE_BITS))
        for batch in batches:
            for start, end, data, offsets in pieces(batch.column(1)):
                at, begin = _trigrams(data, offsets)
                language = np.repeat(batch.column(0).slice(start, end - start).to_numpy(), np.diff(begin))
                counts += np.bincount(language.astype(np.int64) << TABLE_BITS | at, minlength=counts.size).reshape(counts.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(n_languages)), pa.array([c.tobytes() for c in counts], pa.binary())], ["language", "counts"])

    return rows


def fit_trigrams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE):
    """Languages and the logarithms of their trigram probabilities, one row of the table each."""
    labelled = docs.filter(F.col(lang_col).isNotNull() & ~held_out(id_col, 0, 5))
    ids = labelled.select(F.col(id_col).alias("_id")).distinct().orderBy(F.xxhash64("_id")).limit(sample)
    texts = labelled.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    # at most sample ids; texts are counted where they lie
    chosen = stored(texts.join(F.broadcast(ids), "_id").select("lang", "text"), "sample")
    languages = sorted(r.lang for r in chosen.select("lang").distinct().collect())
    table = np.full((len(languages), 1 << TABLE_BITS), 0.5)
    if languages:
        place = F.create_map(*[x for i, lang in enumerate(languages) for x in (F.lit(lang), F.lit(i))])
        for row in chosen.coalesce(2).select(place[F.col("lang")].alias("language"), "text").mapInArrow(
                _counter(len(languages)), "language long, counts binary").collect():
            table[row.language] += np.frombuffer(row.counts)
    return languages, np.log(table / table.sum(axis=1, keepdims=True)).T.astype(np.float32)


def _weighed(table, strip: bool):
    """Adds the log-likelihood per language to ``row, text``."""

    def rows(batches):
        for batch in batches:
            texts = batch.column(1)
            if strip:
                texts = pa.array([visible_text(t.as_py() or "") for t in texts], pa.string())
            for start, end, data, offsets in pieces(texts, 1 << 19):  # a row of numbers per trigram
                at, begin = _trigrams(data, offsets)
                sums = np.concatenate([np.zeros((1, table.value.shape[1])), np.cumsum(table.value[at], axis=0, dtype=np.float64)])
                n = np.diff(begin)
                log = (sums[begin[1:]] - sums[begin[:-1]]) * (np.minimum(1, TEXT_WEIGHT / np.maximum(n, 1)))[:, None]
                log -= log.max(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array(list(log), pa.list_(pa.float64()))], ["row", "log_text"])

    return rows


def _shares(logs: Column) -> Column:
    e = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _summed(shares: str, n: int) -> Column:
    return F.array(*[F.coalesce(F.sum(F.col(shares)[i]), F.lit(0.0)) for i in range(n)])


def _prior(counts: str, wider: str) -> Column:
    """Counts smoothed with ``SMOOTH`` rows spread like the wider prior."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return F.zip_with(counts, wider, lambda c, w: (c + SMOOTH * w) / (total + SMOOTH))


def identify(evidence: DataFrame, languages: list[str]) -> DataFrame:
    """Posterior of rows ``row, log_text, host, domain, declared, hint`` (the last four may be null)."""
    n = len(languages)
    rows = evidence.withColumn("_t", _shares(F.col("log_text")))
    uniform = F.array(*[F.lit(1.0 / n)] * n)
    overall = rows.agg(_summed("_t", n).alias("_all")).select(_prior("_all", uniform).alias("_overall"))  # one row
    hosts = rows.groupBy("host", "domain").agg(_summed("_t", n).alias("_host"))
    domains = hosts.groupBy(F.col("domain").alias("_in")).agg(_summed("_host", n).alias("_domain"))
    priors = (
        hosts.filter("host is not null").join(domains, F.equal_null(F.col("domain"), F.col("_in")), "left")
        .join(F.broadcast(overall)).withColumn("_domain", _prior("_domain", "_overall"))
        .select(F.col("host").alias("_at"), "_in", _prior("_host", "_domain").alias("_prior"))
    )
    # a null domain is a value like others: documents have no domain, nor do hosts without a dot
    same = (F.col("host") == F.col("_at")) & F.equal_null(F.col("domain"), F.col("_in"))
    out = rows.join(priors, same, "left").drop("_at", "_in").join(F.broadcast(overall))
    logs = F.zip_with("log_text", F.coalesce("_prior", "_overall"), lambda a, b: a + F.log(b))
    for name in ("declared", "hint"):
        said = rows.filter(F.col(name).isNotNull()).groupBy(name).agg(_summed("_t", n).alias(f"_{name}"))
        every = said.agg(_summed(f"_{name}", n).alias("_every"))
        said = said.join(F.broadcast(every)).select(
            name, F.zip_with(f"_{name}", "_every", lambda a, b: F.log((a + 1) / (b + n))).alias(f"_{name}"))
        out = out.join(said, name, "left")
        logs = F.zip_with(logs, F.coalesce(f"_{name}", F.array(*[F.lit(0.0)] * n)), lambda a, b: a + b)
    names = F.array(*map(F.lit, languages))
    return out.withColumn("_log", logs).withColumn("posterior", _shares(F.col("_log"))).withColumn(
        "language", F.element_at(names, F.array_position("_log", F.array_max("_log")).cast("int"))
    ).select("row", "language", F.array_max("posterior").alias("confidence"), "posterior", "declared", "hint", "host")


def address_parts(url: Column, languages: list[str]) -> dict[str, Column]:
    """Host, its domain, and the language hint of an address."""
    host = F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    first = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([A-Za-z]{2})(?:[/?#-]|$)", 1))
    return {
        "host": host,
        "domain": F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")),
        "hint": F.when(first.isin(languages), first).otherwise(F.nullif(F.regexp_extract(host, r"\.([a-z]{2,})$", 1), F.lit(""))),
    }


def page_evidence(pages: DataFrame, model, id_col: str = "page_id") -> DataFrame:
    languages, table = model
    page = F.col("html").cast("string")
    declared = F.lower(F.regexp_extract(page, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    parts = address_parts(F.col("url").cast("string"), languages)
    row = F.struct(F.col(id_col).alias("id"), *(c.alias(k) for k, c in parts.items()), F.when(declared.isin(languages), declared).when(declared != "", "other").alias("declared"))
    return _evidence(pages.select(row.alias("row"), page), table, strip=True)


def document_evidence(docs: DataFrame, model, id_col: str = "doc_id", host_col: str = "source") -> DataFrame:
    nothing = F.lit(None).cast("string")
    row = F.struct(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), nothing.alias("domain"), nothing.alias("hint"), nothing.alias("declared"))
    return _evidence(docs.select(row.alias("row"), F.col("text").cast("string")), model[1], strip=False)


def _evidence(rows: DataFrame, table, strip: bool) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(table)
    schema = rows.schema["row"].dataType.simpleString()
    found = rows.mapInArrow(_weighed(sent, strip), f"row {schema}, log_text array<double>")
    return found.select("row.id", "row.host", "row.domain", "row.hint", "row.declared", "log_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op8``: the language of every page and, from text and source alone, of every document."""
    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    model = fit_trigrams(docs)
    none = F.lit(None).cast("long")
    of_pages = stored(page_evidence(pages, model).withColumn("row", F.struct(none.alias("doc_id"), F.col("id").alias("page_id"))), "pages")
    of_docs = stored(document_evidence(docs, model).withColumn("row", F.struct(F.col("id").alias("doc_id"), none.alias("page_id"))), "texts")
    found = [identify(x.drop("id"), model[0]) for x in (of_pages, of_docs)]
    return found[0].unionByName(found[1]).select(
        "row.doc_id", "row.page_id", "language", F.round("confidence", 6).alias("confidence"), "declared", "hint", "host")
