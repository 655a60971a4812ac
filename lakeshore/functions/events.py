"""Object-event normalizing.

Two event shapes reach the lake: API-call records (bucket and key under
``detail.requestParameters``) and object notifications (``detail.bucket.name`` /
``detail.object.key``).  Both become (bucket, key, timestamp ms, last_modified_date,
operation).  Any other shape is an error, or, with ``strict=False``, a NULL
bucket so the row can be routed to quarantine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Detail types and operations of object events.
API_CALL_TYPES = ("AWS API Call via CloudTrail",)
NOTIFICATION_TYPES = ("Object Created", "Object Deleted")
DELETE_OPERATIONS = ("DeleteObject", "Object Deleted")


def normalize_event(event_json, ingest_ms: Column | None = None, strict: bool = True) -> Column:
    """P17 over a JSON text column; ``ingest_ms`` defaults to the query clock."""
    ev = F.col(event_json) if isinstance(event_json, str) else event_json

    def get(path: str) -> Column:
        return F.get_json_object(ev, path)

    kind = get("$.detail-type")
    api = kind.isin(*API_CALL_TYPES)
    note = kind.isin(*NOTIFICATION_TYPES)
    bucket = (F.when(api, get("$.detail.requestParameters.bucketName"))
              .when(note, get("$.detail.bucket.name")))
    key = (F.when(api, get("$.detail.requestParameters.key"))
           .when(note, get("$.detail.object.key")))
    operation = F.when(api, get("$.detail.eventName")).when(note, kind)
    if strict:
        bucket = F.when(api | note, bucket).otherwise(
            F.raise_error(F.concat(F.lit("events of no known source: "), F.coalesce(kind, F.lit("NULL"))))
            .cast("string"))
    time_text = get("$.time")
    last_modified = F.concat(F.split(time_text, r"\.").getItem(0), F.lit("+00:00"))
    if ingest_ms is None:
        ingest_ms = F.unix_millis(F.current_timestamp())
    return F.struct(
        bucket.alias("bucket"), key.alias("key"), ingest_ms.alias("timestamp"),
        last_modified.alias("last_modified_date"), operation.alias("operation"),
        F.coalesce(operation.isin(*DELETE_OPERATIONS), F.lit(False)).alias("is_delete"),
    )
