"""The sentence of a text that names most words of a question, found in one pass over a batch of texts."""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillscreen.functions import text as tx

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BEST = "struct<n:int,at:int,hits:int,sentence:string>"


def best_sentence(text: Column, question: str) -> Column:
    """``n`` sentences, as tx.sentences() splits them; ``at``, ``hits`` and ``sentence``: the place, the number of distinct question words and the text of the
    one with most of them, the first of equal ones; null without a sentence. An expression would keep all tokens of all sentences."""
    wanted = frozenset(w.encode() for w in tx.py_tokens(question))
    uneven, parts = re.compile(tx.UNEVEN), tx.UNEVEN_PARTS
    # What is no part of a token becomes a space; line breaks, which no collapsed text holds, part the sentences.
    spaced = bytes(b if b == 10 or chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))

    @F.arrow_udf(BEST)
    def run(texts: pa.Array) -> pa.Array:
        out: list[tuple] = []
        for t in texts:
            t = t.as_py() or ""
            if any(p in t for p in parts):
                t = uneven.sub(" ", t)
            marked = t.strip(" ").replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n")
            found = [s for s in marked.split("\n") if s]
            most, at = -1, None
            # Lower case keeps spaces and ends of sentences, so it is taken of the whole text.
            for i, s in enumerate(s for s in marked.lower().encode().translate(spaced).split(b"\n") if s):
                hits = len(wanted.intersection(s.split()))
                if hits > most:
                    most, at = hits, i
            out.append((len(found), at, most if found else None, found[at] if found else None))
        n, at, hits, best = zip(*out, strict=True) if out else ((), (), (), ())
        ints = [pa.array(v, pa.int32()) for v in (n, at, hits)]
        return pa.StructArray.from_arrays([*ints, pa.array(best, pa.string())], ["n", "at", "hits", "sentence"])

    # A worker refuses bytes that are no UTF-8.
    return run(F.make_valid_utf8(tx.text(text)))
