"""Token counts without token ids.

In every task the distinct pre-tokens (stretches between ASCII white space) are
counted in pieces once, by the tokenizer library; a document's count is the sum
over its pre-token frequencies of frequency times pieces. Ids of documents are
never built. Nothing is shuffled: a table of (document, pre-token, frequency)
would be several times the input.

Cutting at ASCII white space is exact for tokenizers whose pre-tokens do not
cross white space and that drop it; added tokens inside a text contain none and
are found as the library finds them.

Cases: null counts as empty (0 tokens); repeated rows are counted one by one;
other columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import blocks, raw, text_array
from .pieces import Units


def token_counts(docs: DataFrame, tokenizer: str, id_column: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_tokens) of every text; ``tokenizer`` is a path that executors can read."""
    inner = docs.select(id_column, "text")
    schema = inner.drop("text").schema.add("n_bytes", "long").add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(tokenizer)
        for part in blocks(batches):
            data, at = raw(text_array(part))
            text = data.tobytes()
            frequency = [Counter(text[at[k] : at[k + 1]].split()) for k in range(part.num_rows)]
            pieces = units.sizes(units.numbers([u for f in frequency for u in f]))
            times = np.array([n for f in frequency for n in f.values()], np.int64)
            sums = np.concatenate([[0], np.cumsum(pieces * times)])
            counts = np.diff(sums[np.cumsum([0, *map(len, frequency)])])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(at)), pa.array(counts)], schema.names
            )

    return inner.mapInArrow(run, schema)
