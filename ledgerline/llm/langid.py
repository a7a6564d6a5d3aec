"""Language ID by compression: the language whose dictionary compresses a text best.

Each language has a zstandard raw-content dictionary, cut from its training texts.  A text is
compressed with every dictionary, in chunks, so that a long text doesn't become its own
dictionary; the smallest total wins.  Ties go to the language that comes first in order of code
point.  A text is rejected when the runner-up's total is within ``margin`` of the winner's.

The fit takes a bounded sample: for each language the training documents of least hash, until
they fill DICTIONARY bytes (SAMPLE_CHARS characters of a document at most count here; predictions
read whole texts).  Any number of languages will do: beyond MODEL_BYTES / DICTIONARY of them (256),
each has an equal share of MODEL_BYTES, so the model that travels to the tasks never grows past it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import tidied

#: Bytes of a language's dictionary, sampled documents, and characters of one that go in.
DICTIONARY, SAMPLE_DOCS, SAMPLE_CHARS = 1 << 17, 256, 4000
#: Bytes compressed at a time, and zstandard's level, the cheapest of the best by held-out errors
#: (README): lower levels miss matches, short texts' sizes then tie; level 15 is worse again.
CHUNK, LEVEL = 4096, 11
#: Bytes by which a dictionary must win for the score to double its odds.
BYTES_PER_DOUBLING = 1.0
#: Bytes of all dictionaries, which travel with the tasks.
MODEL_BYTES = 256 * DICTIONARY
#: Languages whose coders a worker holds at a time, and texts times languages whose sizes it holds.
CODERS, SIZES = 256, 1 << 22


def train(labelled: DataFrame, *, dictionary: int = DICTIONARY) -> dict[str, bytes]:
    """Dictionaries from (doc_id, text, lang) rows; null or empty texts and null lang are left out.

    At most SAMPLE_DOCS documents of SAMPLE_CHARS characters reach the driver for a language, a
    partition at a time; it keeps what dictionaries can hold.  No rows give an empty model.
    """
    least = F.struct(F.xxhash64(F.lit(3), F.col("doc_id").cast("string")).alias("h"), F.col("doc_id").cast("string").alias("d"))
    rows = labelled.filter("lang is not null and length(text) > 0").select(
        F.col("lang").cast("string").alias("lang"), least.alias("least"), F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("part"),
        F.substring("text", 1, SAMPLE_CHARS).alias("text"),
    )
    some = W.partitionBy("lang", "part").orderBy("least", "text")
    first = rows.withColumn("n", F.row_number().over(some)).filter(F.col("n") <= SAMPLE_DOCS // 16)
    best = W.partitionBy("lang").orderBy("least", "text")
    chosen = first.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= SAMPLE_DOCS)
    texts: dict[str, list[bytes]] = {}
    held: dict[str, int] = {}
    share = lambda: min(dictionary, max(1, MODEL_BYTES // len(texts)))
    for r in chosen.orderBy("lang", "n").select("lang", "text").toLocalIterator():
        parts = texts.setdefault(r.lang, [])
        if held.get(r.lang, 0) < share():
            parts.append(r.text.encode())
            held[r.lang] = held.get(r.lang, 0) + len(parts[-1])
    # zstandard's matcher prefers what stands last, so the first of the sample come last.
    return {lang: b"\n".join(reversed(parts))[-share():] for lang, parts in sorted(texts.items())}


def _coders(model: dict[str, bytes], names: list[str]) -> list:
    import zstandard

    out = []
    for name in names:
        content = zstandard.ZstdCompressionDict(model[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


@tidied
def _classify(batches: Iterator[pa.RecordBatch], model: dict[str, bytes], text: str) -> Iterator[pa.RecordBatch]:
    names = sorted(model)
    groups = [names[k : k + CODERS] for k in range(0, len(names), CODERS)]
    coders = _coders(model, groups[0]) if groups else []
    for batch in (part for whole in batches for part in _slices(whole, max(1, SIZES // max(1, len(names))))):
        texts = batch.column(text)
        told = np.array([bool(names) and value.is_valid and any(map(str.isalpha, value.as_py())) for value in texts], bool)
        sizes = np.zeros((batch.num_rows, len(names)))
        for g, group in enumerate(groups):
            if len(groups) > 1:
                coders = _coders(model, group)
            # One coder after another: its tables then stay in the processor's caches from text to text.
            for at, coder in enumerate(coders, start=g * CODERS):
                for row in np.flatnonzero(told):
                    raw = memoryview(texts[row].as_buffer())
                    sizes[row, at] = sum(len(coder.compress(raw[k : k + CHUNK])) for k in range(0, len(raw), CHUNK))
        best, score, margin = [], [], []
        for known, size in zip(told, sizes):
            if not known:
                best.append("und")
                score.append(0.0)
                margin.append(0.0)
                continue
            order = np.argsort(size, kind="stable")
            odds = np.exp2(-np.minimum((size - size[order[0]]) / BYTES_PER_DOUBLING, 1000))
            best.append(names[order[0]])
            score.append(float(1 / odds.sum()))
            margin.append(float(size[order[1]] / size[order[0]] - 1) if len(order) > 1 else 1.0)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())],
            names=[*batch.schema.names, "lang_pred", "score", "margin"],
        )


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    yield from (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))


def classify(packed: DataFrame, model: dict[str, bytes], *, text: str = "text") -> DataFrame:
    """The rows with lang_pred, score and margin.

    ``und`` with score 0 where the text is null or has no letter, or the model has no language.
    ``score`` is the winner's share when each byte more halves a language's odds; ``margin`` is
    the runner-up's size over the winner's, less 1.
    """
    # Dictionaries travel with the function: MODEL_BYTES at most.
    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType())]
    schema = T.StructType([*packed.schema.fields, *more])
    return packed.mapInArrow(partial(_classify, model=model, text=text), schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that no model learns from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, margin) of each row, learnt from rows not held out.

    A null doc_id is not held out.  Other columns than doc_id, text and lang are ignored.  Repeated
    rows are told alike, a row each; no rows give none.
    """
    model = train(docs.filter(~held_out()))
    return classify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out")), model).drop("text").select(
        "doc_id", "held_out", "lang_pred", "score", "margin"
    )
