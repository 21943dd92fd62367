"""Column types of the documents and tables, and the counters that are tracked."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING, _INT, _LONG, _DOUBLE, _BOOL = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()

STRING_MAP = T.MapType(_STRING, _STRING)
FIELD_MAP = T.MapType(_STRING, T.ArrayType(_STRING))
COUNTER_MAP = T.MapType(_STRING, T.MapType(_STRING, _LONG))
#: A document with fields of the reporter's own choice; numbers stay the numbers that were posted.
OPEN = T.VariantType()
EDGE_MAP = T.MapType(_STRING, T.ArrayType(_INT))

# Counter groups, and per step column the (group, counter) it is read from.
JOB = "mapreduce.JobCounter"
FILES = "mapreduce.FileSystemCounter"
TASK = "mapreduce.TaskCounter"
STEP = "cascading.flow.StepCounters"
SLICE = "cascading.flow.SliceCounters"

STEP_COUNTERS = {
    "map_tasks": (JOB, "TOTAL_LAUNCHED_MAPS"),
    "reduce_tasks": (JOB, "TOTAL_LAUNCHED_REDUCES"),
    "failed_map_tasks": (JOB, "NUM_FAILED_MAPS"),
    "failed_reduce_tasks": (JOB, "NUM_FAILED_REDUCES"),
    "data_local_map_tasks": (JOB, "DATA_LOCAL_MAPS"),
    "rack_local_map_tasks": (JOB, "RACK_LOCAL_MAPS"),
    "map_vcore_millis": (JOB, "VCORES_MILLIS_MAPS"),
    "reduce_vcore_millis": (JOB, "VCORES_MILLIS_REDUCES"),
    "hdfs_bytes_read": (FILES, "HDFS_BYTES_READ"),
    "hdfs_bytes_written": (FILES, "HDFS_BYTES_WRITTEN"),
    "gs_bytes_read": (FILES, "GS_BYTES_READ"),
    "gs_bytes_written": (FILES, "GS_BYTES_WRITTEN"),
    "file_bytes_read": (FILES, "FILE_BYTES_READ"),
    "file_bytes_written": (FILES, "FILE_BYTES_WRITTEN"),
    "tuples_read": (STEP, "Tuples_Read"),
    "tuples_written": (STEP, "Tuples_Written"),
    "io_read_millis": (SLICE, "Read_Duration"),
    "io_write_millis": (SLICE, "Write_Duration"),
    "cpu_millis": (TASK, "CPU_MILLISECONDS"),
    "gc_millis": (TASK, "GC_TIME_MILLIS"),
}
# Read only for the totals of a flow.
TOTAL_ONLY_COUNTERS = {
    "shuffled_maps": (TASK, "SHUFFLED_MAPS"),
    "map_records_out": (TASK, "MAP_OUTPUT_RECORDS"),
    "reduce_records_in": (TASK, "REDUCE_INPUT_RECORDS"),
    "reduce_records_out": (TASK, "REDUCE_OUTPUT_RECORDS"),
    "map_bytes_out": (TASK, "MAP_OUTPUT_BYTES"),
    "merged_map_outputs": (TASK, "MERGED_MAP_OUTPUTS"),
    "reduce_shuffle_bytes": (TASK, "REDUCE_SHUFFLE_BYTES"),
    "spilled_records": (TASK, "SPILLED_RECORDS"),
    "heap_committed_bytes": (TASK, "COMMITTED_HEAP_BYTES"),
    "virtual_mem_bytes": (TASK, "VIRTUAL_MEMORY_BYTES"),
    "physical_mem_bytes": (TASK, "PHYSICAL_MEMORY_BYTES"),
}
# Counters whose absence is told apart from zero.
NULLABLE_COUNTERS = ["gs_bytes_read", "gs_bytes_written"]

# Total of a flow -> step column it sums.
FLOW_TOTALS = {
    "flow_hdfs_bytes_read": "hdfs_bytes_read",
    "flow_file_bytes_read": "file_bytes_read",
    "flow_gs_bytes_read": "gs_bytes_read",
    "flow_hdfs_bytes_written": "hdfs_bytes_written",
    "flow_file_bytes_written": "file_bytes_written",
    "flow_gs_bytes_written": "gs_bytes_written",
    "flow_total_map_tasks": "map_tasks",
    "flow_total_reduce_tasks": "reduce_tasks",
    "flow_map_vcore_millis": "map_vcore_millis",
    "flow_reduce_vcore_millis": "reduce_vcore_millis",
    "flow_shuffled_maps": "shuffled_maps",
    "flow_map_records_out": "map_records_out",
    "flow_reduce_records_in": "reduce_records_in",
    "flow_reduce_records_out": "reduce_records_out",
    "flow_map_bytes_out": "map_bytes_out",
    "flow_merged_map_outputs": "merged_map_outputs",
    "flow_reduce_shuffle_bytes": "reduce_shuffle_bytes",
    "flow_cpu_millis": "cpu_millis",
    "flow_gc_millis": "gc_millis",
    "flow_spilled_records": "spilled_records",
    "flow_heap_committed_bytes": "heap_committed_bytes",
    "flow_virtual_mem_bytes": "virtual_mem_bytes",
    "flow_physical_mem_bytes": "physical_mem_bytes",
    "flow_tuples_read": "tuples_read",
    "flow_tuples_written": "tuples_written",
}


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


FLOW_DOC = _struct(
    flow_id=_STRING,
    flow_name=_STRING,
    jt_url=_STRING,
    user_name=_STRING,
    tmp_dir=_STRING,
    flow_status=_STRING,
    total_stages=_INT,
    flow_duration=_LONG,
    flow_priority=_INT,
    cascade_id=_STRING,
    yarn_job_history=_STRING,
    hdfs_working_dir=_STRING,
    flow_start_epoch_ms=_LONG,
    flow_submit_epoch_ms=_LONG,
    flow_end_epoch_ms=_LONG,
    flow_links=_STRING,
    aggregated=OPEN,  # totals, progress and users' own values
    config_props=STRING_MAP,
)

STEP_DOC = _struct(
    step_number=_INT,
    sources=FIELD_MAP,
    sink=FIELD_MAP,
    job_id=_STRING,
    step_id=_STRING,
    map_progress=_DOUBLE,
    reduce_progress=_DOUBLE,
    step_status=_STRING,
    step_priority=_INT,
    step_running_time=_LONG,
    step_start_epoch_ms=_LONG,
    step_submit_epoch_ms=_LONG,
    step_end_epoch_ms=_LONG,
    has_reduce_stage=_BOOL,
    counters=COUNTER_MAP,
    config_props=STRING_MAP,
)

AGG_DOC = _struct(flow_id=_STRING, epoch_ms=_LONG, agg_json=OPEN)

# Stores, as they are kept: key columns, dates in epoch seconds and the document as text.
FLOW_TABLE = _struct(
    flow_id=_STRING, flow_name=_STRING, flow_status=_STRING, flow_json=_STRING, update_date=_LONG, create_date=_LONG
)
STEP_TABLE = _struct(step_id=_STRING, flow_id=_STRING, step_json=_STRING, update_date=_LONG, create_date=_LONG)
EDGE_TABLE = _struct(flow_id=_STRING, src_stage=_INT, dest_stage=_INT, update_date=_LONG, create_date=_LONG)
AGG_TABLE = _struct(epoch_ms=_LONG, flow_id=_STRING, agg_json=_STRING)
