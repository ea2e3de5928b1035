"""BPE encoding and decoding of whole texts by forced-boundary splitting (see ``tokenize.ForcedBoundaryEncoder``).

Null texts count as empty and give no ids; ids are passed through, nulls and repeats included. Very long texts are encoded
whole. The vocabulary's path is a parameter; every executor reads it from its own installation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import text_of


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32 bytes) and decoded text; with ``digest`` their sha256 instead."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from .tokenize import forced_boundary

        code = forced_boundary(tokenizer).encode
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for lo in range(0, len(keys), 256):
                got = code(texts.slice(lo, 256).to_pylist())
                n = pa.array([len(ids) // 4 for ids, _ in got], pa.int64())
                if digest:
                    rest = [pa.array([hashlib.sha256(g[k]).hexdigest() for g in got]) for k in (0, 1)]
                else:
                    rest = [pa.array([g[0] for g in got], pa.binary()), pa.array([g[1].decode() for g in got])]
                yield pa.RecordBatch.from_arrays([keys.slice(lo, 256), n, *rest], ["doc_id", "n_tokens", *names])

    names = ["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]
    kind = docs.schema[id_col].dataType.simpleString()
    return text_of(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, {names[0]} {'string' if digest else 'binary'}, {names[1]} string")
