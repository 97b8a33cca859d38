"""SentencePiece encoding and decoding of documents through the compiled transducer.

Defined cases: a null text encodes like the empty text, to no pieces; every row gives one row; an empty table gives no rows; columns
named like the results are replaced; a text with a literal U+2581 decodes to a space there, as that character is the model's space.
"""

from __future__ import annotations

import hashlib
import sys
from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillscreen.llm.common import documents
from quillscreen.llm.transducer import BYTES, Transducer

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_compiled: dict[str, Transducer] = {}
MODEL = "piece_bpe_32k.model"
#: Rows whose texts are Python strings at once.
ROWS = 256
NAMES = ["n_pieces", "n_byte_pieces", "ids_sha256", "decoded_sha256", "round_trip"]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
REPORT = "n_pieces long, n_byte_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def _loader(path: str):
    """Function that gives the transducer, compiled once per worker; the model's bytes are read on the driver."""
    with open(path, "rb") as f:
        data = f.read()
    key = hashlib.sha256(data).hexdigest()

    def load() -> Transducer:
        if key not in _compiled:
            _compiled[key] = Transducer(data)
        return _compiled[key]

    return load


def encode(docs: DataFrame, model_path: str, text_col: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with the piece ids of each text as an array."""
    load = _loader(model_path)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        t = load()
        return texts.map(lambda x: t.encode(x or ""))

    return docs.withColumn(to, ids(F.coalesce(F.col(text_col), F.lit(""))))


def decode(docs: DataFrame, model_path: str, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """``docs`` with the text of each array of piece ids; null ids give the empty text."""
    load = _loader(model_path)

    @F.pandas_udf(T.StringType())
    def text(ids: pd.Series) -> pd.Series:
        t = load()
        return ids.map(lambda x: t.decode(() if x is None else [int(i) for i in x]))

    return docs.withColumn(to, text(F.col(ids_col)))


def digest(ids: list[int]) -> str:
    """SHA-256 over the ids as little-endian 32-bit integers."""
    a = array("i", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return hashlib.sha256(a.tobytes()).hexdigest()


def piece_report(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` with the size and digest of each document's encoding, and whether it decodes to the text; ids stay in the worker."""
    load, kind = _loader(model_path), docs.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load()
        for batch in it:
            for at in range(0, batch.num_rows, ROWS):
                part, rows = batch.slice(at, ROWS), []
                for text in part.column(1).to_pylist():
                    text = text or ""
                    ids = t.encode(text)
                    shown = "".join(map(t.shown.__getitem__, ids))
                    back = t.finish(shown)
                    rows.append((len(ids), sum(map(len, BYTES.findall(shown))), digest(ids), hashlib.sha256(back.encode()).hexdigest(), back == text))
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, KINDS, strict=True))], ["doc_id", *NAMES])
        t.forget()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id {kind}, {REPORT}")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding of all documents with the 32k BPE model with byte fallback."""
    return piece_report(documents(spark, sf_dir), default_model())
