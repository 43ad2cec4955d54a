"""Token counts of a public byte-level vocabulary, Arrow batch by Arrow batch."""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-splitting pattern that goes with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_count(df: DataFrame, text: str, name: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """Replace column ``text`` by its token count. Null and empty texts count 0. All other columns stay."""
    keep = [c for c in df.columns if c != text]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(name, T.LongType())])

    def count(batches):
        enc = encoder(vocabulary)
        for b in batches:
            texts = ["" if t is None else t for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            sizes = [len(x) for x in enc.encode_ordinary_batch(texts, num_threads=1)]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in keep], pa.array(sizes, pa.int64())], names=[*keep, name])

    return df.select(*keep, text).mapInArrow(count, schema)


#: A token as the tables count them: an ideograph, or a run of other characters that are no white space of Unicode.
RUNS = r"[\x{4e00}-\x{9fff}]|[^\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{4e00}-\x{9fff}]+"


def with_run_count(df: DataFrame, text: str, name: str = "size") -> DataFrame:
    """Add the number of tokens (RUNS) of a text column, counted on whole Arrow columns. Null texts count 0."""
    import pyarrow.compute as pc

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.IntegerType())])
    names = [*df.columns, name]

    def count(batches):
        for b in batches:
            n = pc.fill_null(pc.count_substring_regex(b.column(b.schema.get_field_index(text)).cast(pa.string()), RUNS), 0)
            yield pa.RecordBatch.from_arrays([*b.columns, n.cast(pa.int32())], names=names)

    return df.mapInArrow(count, schema)
