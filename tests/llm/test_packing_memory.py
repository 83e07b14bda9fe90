"""What an encoding worker of packing holds at once."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from tessera.llm import packing
from tessera.llm.token_ids import PieceEncoder


def test_batches_are_encoded_in_slices_of_bounded_rows():
    batches = [pa.record_batch({"doc_id": pa.array(range(n))}) for n in (0, 1, 2500, packing.ROWS)]
    parts = list(packing.row_slices(iter(batches)))
    assert max(p.num_rows for p in parts) <= 1024
    assert [x for p in parts for x in p.column(0).to_pylist()] == [x for b in batches for x in b.column(0).to_pylist()]


def test_kept_pieces_are_few_and_further_ones_are_encoded_alike():
    encoder = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    letters = np.array(list("abcdefghijklmnop"))
    words = ["".join(letters[[n >> 16 & 15, n >> 12 & 15, n >> 8 & 15, n >> 4 & 15, n & 15]]) for n in range(300_000)]
    encoder.encode([" " + " ".join(words)])
    assert len(encoder.kept) <= 250_000
    late = [" " + " ".join(words[-50:]), "a " + words[-1]]
    assert encoder.encode(late) == encoder._library_ids(late)
