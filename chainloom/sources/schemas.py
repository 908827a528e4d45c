"""Declared schemas.  Nothing is inferred from data."""

from pyspark.sql import types as T

RAW_LOG = T.StructType(
    [
        T.StructField("chain", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("topics", T.ArrayType(T.StringType())),
        T.StructField("topic0", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("block_number", T.LongType()),
        T.StructField("block_timestamp", T.LongType()),
        T.StructField("transaction_hash", T.StringType()),
        T.StructField("log_index", T.IntegerType()),
        T.StructField("block_bucket", T.LongType()),
    ]
)

# Landed logs also say which landing they came with, and as which row of it.
LANDED_LOG = T.StructType([*RAW_LOG.fields, T.StructField("landed_as", T.StringType())])

CHUNK_BLOCKS = 1000  # blocks of one fetch
# Blocks of one folder.  Coarse, as a sparse chain would else have a folder for each row; files
# are sorted, so that a range of blocks still reads few row groups.
BUCKET_BLOCKS = 100_000
EVENT_BUCKET_BLOCKS = 100_000
META = ("block_number", "block_timestamp", "transaction_hash", "log_index")
LOG_KEY = ("chain", "transaction_hash", "log_index")

SPEC_DOCUMENT = T.StructType(
    [
        T.StructField("event_name", T.StringType()),
        T.StructField("event_signature", T.StringType()),
        T.StructField("start_block", T.LongType()),
        T.StructField("contract_address", T.StringType()),
        T.StructField("chain", T.StringType()),
        T.StructField(
            "indexed_fields",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("solidity_type", T.StringType()),
                        T.StructField("rust_type", T.StringType()),
                        T.StructField("indexed", T.BooleanType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "table_schema",
            T.StructType(
                [
                    T.StructField("table_name", T.StringType()),
                    T.StructField(
                        "columns",
                        T.ArrayType(
                            T.StructType(
                                [T.StructField("name", T.StringType()), T.StructField("type", T.StringType())]
                            )
                        ),
                    ),
                    T.StructField("indexes", T.ArrayType(T.StringType())),
                ]
            ),
        ),
        T.StructField("description", T.StringType()),
    ]
)

TUPLE_DEPTH = 3  # tuples in tuples in tuples


def _abi_inputs(depth: int) -> T.ArrayType:
    fields = [T.StructField("name", T.StringType()), T.StructField("type", T.StringType()), T.StructField("indexed", T.BooleanType())]
    if depth:
        fields.append(T.StructField("components", _abi_inputs(depth - 1)))
    return T.ArrayType(T.StructType(fields))


ABI_DOCUMENT = T.ArrayType(
    T.StructType(
        [
            T.StructField("type", T.StringType()),
            T.StructField("name", T.StringType()),
            T.StructField("anonymous", T.BooleanType()),
            T.StructField("inputs", _abi_inputs(TUPLE_DEPTH)),
        ]
    )
)
