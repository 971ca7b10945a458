"""Schemas of the documents and tables the readers produce."""

from __future__ import annotations

OWNERS = "array<struct<discord: string, github: string>>"

TARGET = (
    "struct<drvPath: string, attrPath: array<string>, system: string, devAttrType: string, "
    f"owners: {OWNERS}, deps: array<string>, outputs: map<string, string>>"
)

RESULT_TARGET = (
    "struct<tree_path: string, drv_path: string, dev_attr_type: string, status: string, "
    f"duration_ms: bigint, exit_code: bigint, owners: {OWNERS}, log_tail: string>"
)

RESULTS = (
    f"system string, branch string, commit string, success boolean, targets array<{RESULT_TARGET}>"
)

LOG_LINE = (
    "action string, fields array<variant>, id bigint, level int, parent bigint, text string, "
    "msg string, rawMsg string, type bigint"
)

API_PAGE = (
    "data struct<pipeline: struct<builds: struct<edges: array<struct<node: struct<commit: string, "
    "jobs: struct<edges: array<struct<node: struct<artifacts: struct<edges: array<struct<node: "
    "struct<path: string, downloadURL: string>>>>>>>>>>>>>>"
)

RESULT_ROW = (
    "system string, tree_path string, drv_path string, dev_attr_type string, status string, "
    f"duration_ms bigint, exit_code bigint, owners {OWNERS}, log_tail string, retry_count int, "
    "branch string, commit string"
)
