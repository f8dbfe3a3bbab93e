"""Column expressions; all run inside Spark's generated code."""

from quarryline.functions.hashing import combine_hashes, hash_int32, partition_of, slot_of
from quarryline.functions.scalar import bytes_humanize, bytes_parse, column_file_name, next_pow2, profit, round_up, table_size

__all__ = ["bytes_humanize", "bytes_parse", "column_file_name", "combine_hashes", "hash_int32", "next_pow2", "partition_of", "profit", "round_up", "slot_of", "table_size"]
