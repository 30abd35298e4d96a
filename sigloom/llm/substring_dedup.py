"""Substring deduplication: windows of words that also start in an earlier document are removed.

A first pass adds every window to count-min sketches, one per partition, which are merged block by block. A
window is entered by its minimizer, the least hash of the shorter word runs inside it, once per document and value: equal
windows have equal minimizers, so the sketch never estimates a window's documents too low, and neighbouring
windows share their entries. A second pass groups exactly only the windows whose estimate reaches two documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.common import Query, documents, narrow, stored
from sigloom.llm.sketch import Sketch, bit_table
from sigloom.llm.textops import Words, covered, ids_of, mix, rolling, signed, sliding_min, small

_SECOND = np.uint64(0xA0761D6478BD642F)


def window_keys(hashes: np.ndarray, width: int) -> np.ndarray:
    """Minimizer of every window of ``width`` words: the least hash of the runs of half that length inside it."""
    run = max(1, width // 2)
    return sliding_min(rolling(hashes, run), width - run + 1)


def _batched_windows(column: pa.Array, width: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a batch, the starts of its windows, their keys and the rows they lie in."""
    words = Words(column)
    n, rows = len(words.hashes), words.rows()
    if n < width:
        return words, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.flatnonzero(rows[width - 1 :] == rows[: n - width + 1])
    return words, starts, window_keys(words.hashes, width)[starts], rows[starts]


def document_keys(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The minimizers of a batch's windows, once per document and value."""
    _, _, keys, rows = _batched_windows(batch.column("text"), width)
    change = np.ones(len(keys), bool)
    change[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    keys, rows = keys[change], rows[change]
    return keys[np.unique(keys ^ mix(rows.astype(np.uint64)), return_index=True)[1]]


def removed_windows(texts: DataFrame, width: int, sketch: Sketch) -> DataFrame:
    """Starts of the windows to remove: doc_id, row, start (in words).

    Windows estimated repeated are grouped by a 128-bit digest of their words. The grouping combines inside every task
    before it shuffles; the join back splits hot digests.
    """
    shared = bit_table(texts.select("text"), lambda batch: document_keys(batch, width), sketch, 2)

    def candidates(batches):
        for batch in small(batches):
            words, starts, keys, rows = _batched_windows(batch.column("text"), width)
            found = sketch.marked(keys, shared.value)
            starts, rows = starts[found], rows[found]
            digests = [signed(rolling(values, width)[starts]) for values in (words.hashes, mix(words.hashes ^ _SECOND))] if len(starts) else [starts, starts]
            ranks = ids_of(batch.column("doc_id"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (*digests, ranks[rows], batch.column("row").to_numpy()[rows], starts - words.offsets[rows])],
                ["h1", "h2", "id", "row", "start"],
            )

    schema = "h1 bigint, h2 bigint, id bigint, row bigint, start bigint"
    windows = texts.select("doc_id", "row", "text").mapInArrow(candidates, schema)
    first = windows.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("first_id < last_id")
    # a table of its own, so that the join meets two plain shuffles, of which Spark splits a hot digest's part
    first = stored(first.drop("last_id"), "first-places")
    return windows.join(first, ["h1", "h2"]).where("id > first_id").select("id", "row", "start")


def substring_dedup(docs: DataFrame, width: int = 50, sketch: Sketch = Sketch()) -> DataFrame:
    """What is left of every document: doc_id, n_words, n_removed, kept_sha256, row.

    One row per input row. A null or empty text has no words and keeps the empty text. A null doc_id ranks behind every id, so such
    rows lose what any other document has; rows with equal ids are one document and lose nothing to each other. An empty table gives no rows.
    """
    texts = narrow(docs)
    gone = removed_windows(texts, width, sketch).groupBy("id", "row").agg(F.sort_array(F.collect_set("start")).alias("starts"))
    gone = stored(gone, "removed-windows")
    last = F.lit(2**63 - 1)
    marked = texts.withColumn("id", F.coalesce("doc_id", last)).join(gone, ["id", "row"], "left").select("doc_id", "row", "text", "starts")

    def keep(batches):
        for batch in small(batches):
            words = Words(batch.column("text"), hashes=False)
            counts, at, raw = words.counts(), words.offsets.tolist(), words.data.tobytes()
            starts = batch.column("starts")
            offsets = starts.offsets.to_numpy() if len(starts) else np.zeros(1, np.int32)
            values = starts.values.to_numpy(zero_copy_only=False) if len(starts) else np.zeros(0, np.int64)
            removed, digests = np.zeros(len(words), np.int64), []
            for i in range(len(words)):
                own = raw[words.row_bytes[i] : words.row_bytes[i + 1]].split()
                if offsets[i + 1] > offsets[i]:
                    mask = covered(values[offsets[i] : offsets[i + 1]], width, at[i + 1] - at[i])
                    removed[i] = mask.sum()
                    own = [w for w, drop in zip(own, mask.tolist()) if not drop]
                digests.append(hashlib.sha256(b" ".join(own)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed), pa.array(digests, pa.string()), batch.column("row")],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "row"],
            )

    return marked.mapInArrow(keep, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, row bigint")


SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
  win AS (SELECT doc_id, unnest(generate_series(1, len(words) - 49)) AS s,
    unnest(list_transform(generate_series(1, len(words) - 49), lambda i: md5(array_to_string(words[i:i + 49], ' ')))) AS h FROM w WHERE len(words) >= 50),
  first AS (SELECT h, min(doc_id) AS first_id FROM win GROUP BY h),
  gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 49)) AS p FROM win JOIN first USING (h) WHERE doc_id > first_id),
  p AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
  SELECT doc_id, len(words) AS n_words, coalesce(len(ps), 0) AS n_removed,
    sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN words ELSE list_transform(list_filter(list_zip(words, generate_series(1, len(words))),
      lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]) END, ' '), '')) AS kept_sha256
  FROM w LEFT JOIN p USING (doc_id)"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir)).drop("row")


QUERIES = [Query("op4_substring_dedup", op4_substring_dedup, SQL)]
