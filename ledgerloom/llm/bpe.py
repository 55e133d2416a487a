"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts longer than ``PIECE`` characters are cut before encoding, each cut right before a space,
tab or line break that follows a character other than white space. No match of the pattern
spans such a place and none looks back over it, so the ids are those of the whole text. A text
without such a place stays whole. Ids are decoded to raw bytes.

Defined cases: null is the empty text, with no ids. Strings of special tokens are ordinary
text. Repeated rows give a row each. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters of text that are encoded at a time.
PIECE = 1 << 16
CUT = r"(?<=\S)[ \t\n\r]"


def load_encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in order, cut at safe places about ``size`` characters apart."""
    cut, lo = re.compile(CUT), 0
    while len(text) - lo > size:
        place = cut.search(text, lo + size)
        if place is None:
            break
        yield text[lo : place.start()]
        lo = place.start()
    yield text[lo:]


def encode(encoding, text: str, size: int = PIECE) -> np.ndarray:
    """Ids as little-endian unsigned 32-bit integers."""
    ids = [encoding.encode_ordinary(piece) for piece in pieces(text, size)]
    return np.fromiter((i for part in ids for i in part), "<u4", sum(map(len, ids)))


def decode(encoding, ids: np.ndarray) -> bytes:
    return encoding.decode_bytes(ids.tolist())


def _coder(rank_file: str, pattern: str, with_ids: bool) -> Callable:
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(rank_file, pattern)
        for frame in frames:
            rows = []
            for text in frame.column("text"):
                ids = encode(encoding, text.as_py() or "")
                rows.append(
                    (
                        len(ids),
                        hashlib.sha256(ids.tobytes()).hexdigest(),
                        hashlib.sha256(decode(encoding, ids)).hexdigest(),
                        ids.astype(np.int32) if with_ids else None,
                    )
                )
            n_tokens, of_ids, of_bytes, kept = zip(*rows) if rows else ((), (), (), ())
            columns = [frame.column("doc_id"), pa.array(n_tokens, pa.int64())]
            columns += [pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode_documents(
    docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = True
) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids])``, a row for each row.

    ``rank_file`` is a path that every executor can open.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>"
    chosen = docs.select("doc_id", "text")
    return chosen.mapInArrow(_coder(rank_file, pattern, with_ids), schema)
