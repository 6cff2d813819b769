"""Row shapes of the key/value engine."""

#: A logged insert: sequence number, key, 32-bit value, whole payload.
INSERT = "seq long not null, k long not null, v int, payload binary"
#: An insert with the epoch (memtable generation) that it belongs to.
LOGGED = "seq long, k long, v int, payload binary, epoch long"
#: A stored record of a run; `run_id` and `level` stand in the manifest.
RECORD = "k long, v int, payload binary, seq long, epoch long"
#: One row per run of a store version; a node's keys lie above low and up to high, and those up to consumed_upto were moved down.
MANIFEST = "run_id long, level int, epoch long, path string, min_k long, max_k long, n_rows long, n_pages long, consumed_upto long, low long, high long"
#: One row per merge of a store: level written to, records and nodes that it held before, records after.
MERGES = "level int, rows_in long, nodes int, rows_out long, seconds double"
#: One step of a workload.
OPERATION = "op_no long, is_query boolean, is_range boolean, is_insertion boolean, key long, high long, val int"
#: A place on disk.
POINTER = "struct<disk:tinyint,location:bigint,file_no:int>"
