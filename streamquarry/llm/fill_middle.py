"""Fill-in-the-middle rewriting of documents as a pipeline of Arrow kernels.

Per batch: texts are split into units (lines, each with its line feed) as list arrays, flattened
with the index of their parent, and numbered within it.  Two borders per text cut the numbers into
the roles prefix, middle and suffix.  Units are filtered by role, lists are rebuilt per role and
joined to one string each, and markers and pieces are joined to the output.  No Python code runs
per row.

Borders, whether a text is left plain, and the order of the pieces come from the first four groups
of eight hex digits of ``sha256(seed:id)``, so they depend on the id alone and a task that runs
again gives the same rows.

A text that is empty or holds a marker stays plain.  Null texts count as empty, a null id as the
empty string.  Repeated rows are rewritten alike; every row gives one row.  Texts are taken
whole, some megabytes of them at a time.  Other columns are carried along in the struct ``row``,
so their names cannot clash.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"  # fixed values: the markers of the contract
SEED = "7"
PLAIN, SPM, PSM = "plain", "spm", "psm"
BYTES = 8 << 20  # text that one run of the kernels takes, whole texts


def draws(id_col: Column, seed: str) -> list[Column]:
    """The first four groups of eight hex digits of the id's digest, as integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _units(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """``n`` per text, and the units of all texts with their parent and ordinal: lines with their line feed."""
    parts = pc.split_pattern(texts, "\n")
    closed = pc.or_(pc.ends_with(texts, "\n"), pc.equal(pc.binary_length(texts), 0))  # nothing follows the last line feed
    n_parts = pc.cast(pc.list_value_length(parts), pa.int64())
    parent, line = pc.list_parent_indices(parts), pc.list_flatten(parts)
    ordinal = pc.subtract(pa.array(np.arange(len(line))), pc.cast(pc.take(parts.offsets, parent), pa.int64()))
    last = pc.equal(pc.add(ordinal, 1), pc.take(n_parts, parent))
    feed = pc.if_else(last, pa.scalar("", line.type), pa.scalar("\n", line.type))
    line = pc.binary_join_element_wise(line, feed, pa.scalar("", line.type))
    whole = pc.invert(pc.and_(last, pc.take(closed, parent)))
    n = pc.subtract(n_parts, pc.cast(closed, pa.int64()))
    return n, *(pc.filter(x, whole) for x in (line, parent, ordinal))


def _joined(units: pa.Array, role: pa.Array, sizes: pa.Array) -> pa.Array:
    """The units where ``role`` holds, ``sizes`` of them per text, joined to one string each."""
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(sizes)])
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, pc.filter(units, role)), pa.scalar("", units.type))


def rewrite(texts: pa.Array, cuts: list[pa.Array], stays: pa.Array, spm: pa.Array) -> list[pa.Array]:
    """``n, form, prefix_chars, middle_chars, output`` of texts that have two draws in ``cuts`` each."""
    texts = pc.cast(texts, pa.large_string())
    n, units, parent, ordinal = _units(texts)
    places = pc.add(n, 1)
    borders = [pc.subtract(h, pc.multiply(pc.divide(h, places), places)) for h in cuts]
    begin, end = pc.min_element_wise(*borders), pc.max_element_wise(*borders)
    before, upto = pc.less(ordinal, pc.take(begin, parent)), pc.less(ordinal, pc.take(end, parent))
    prefix = _joined(units, before, begin)
    middle = _joined(units, pc.and_(upto, pc.invert(before)), pc.subtract(end, begin))
    suffix = _joined(units, pc.invert(upto), pc.subtract(n, end))
    held = [pc.match_substring(texts, m) for m in (PREFIX, SUFFIX, MIDDLE)]
    plain = pc.or_(pc.or_(pc.equal(n, 0), stays), pc.or_(held[0], pc.or_(held[1], held[2])))
    p, s, m = (pa.scalar(x, pa.large_string()) for x in (PREFIX, SUFFIX, MIDDLE))
    nothing = pa.scalar("", pa.large_string())
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, nothing)
    spm_text = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, nothing)
    output = pc.if_else(plain, texts, pc.if_else(spm, spm_text, psm))
    form = pc.if_else(plain, PLAIN, pc.if_else(spm, SPM, PSM))
    chars = [pc.if_else(plain, None, pc.cast(pc.utf8_length(x), pa.int64())) for x in (prefix, middle)]
    return [n, form, *chars, pc.cast(output, pa.string())]


def _slices(texts: pa.Array):
    """``(first, n)`` of runs of whole texts of about ``BYTES``."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start, done = 0, 0
    while start < len(texts):
        n = max(1, int(np.searchsorted(ends, done + BYTES, "right")) - start)
        yield start, n
        start += n
        done = int(ends[start - 1])


def _rows(batches):
    for batch in batches:
        texts = pc.fill_null(batch.column(5), "")
        for start, n in _slices(texts):
            row, h1, h2, stays, spm = (batch.column(i).slice(start, n) for i in range(5))
            yield pa.RecordBatch.from_arrays(
                [row, *rewrite(texts.slice(start, n), [h1, h2], stays, spm)],
                ["row", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(
    docs: DataFrame, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text",
    seed: str = SEED, rewritten: int = 100, spm: int = 50,
) -> DataFrame:
    """A row per document: ``row`` (its columns ``carry``, all by default), ``n`` units, ``form``,
    ``prefix_chars``, ``middle_chars`` (null if plain) and the ``output``.

    ``rewritten`` of a hundred texts are cut, ``spm`` of a hundred of these put the suffix first.
    """
    kept = [F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]
    h = draws(F.col(f"`{id_col}`"), seed)
    packed = docs.select(
        F.struct(*kept).alias("row"), h[0].alias("h1"), h[1].alias("h2"),
        (h[2] % 100 >= rewritten).alias("stays"), (h[3] % 100 < spm).alias("spm"),
        F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(
        _rows, f"row {schema}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: each marker occurs once in an output that is not plain."""
    middle = F.substring_index(output, MIDDLE, -1)
    head = F.substring_index(output, MIDDLE, 1)
    after_p, after_s = F.substring_index(head, PREFIX, -1), F.substring_index(head, SUFFIX, -1)
    upto_p, upto_s = F.substring_index(head, PREFIX, 1), F.substring_index(head, SUFFIX, 1)
    marker = F.lit(len(PREFIX) + 1)
    psm = F.concat(F.substring(upto_s, marker, F.char_length(upto_s)), middle, after_s)
    spm = F.concat(after_p, middle, F.substring(upto_p, marker, F.char_length(upto_p)))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op12``: every document rewritten, as lengths and digests of the output and of what is rebuilt from it."""
    rows = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return rows.select(
        "row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = """
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units,
           sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS digest
    FROM documents
), drawn AS (
    SELECT *, len(units)::BIGINT AS n,
           ('0x' || substr(digest, 1, 8))::BIGINT % (len(units) + 1) AS b1,
           ('0x' || substr(digest, 9, 8))::BIGINT % (len(units) + 1) AS b2,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                  OR ('0x' || substr(digest, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
                WHEN ('0x' || substr(digest, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM cut
), parts AS (
    SELECT *, array_to_string(units[1:least(b1, b2)], '') AS prefix,
           array_to_string(units[least(b1, b2) + 1:greatest(b1, b2)], '') AS middle,
           array_to_string(units[greatest(b1, b2) + 1:], '') AS suffix
    FROM drawn
), made AS (
    SELECT *, CASE form WHEN 'plain' THEN text
           WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
           ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output
    FROM parts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(output) AS output_sha256, sha256(text) AS restored_sha256
FROM made
"""
