"""Mail files (.eml) as rows: the header block, and the parts of the body in depth-first order."""

from __future__ import annotations

from email import message_from_bytes, policy

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "struct<part:string,mime_type:string,disposition:string,embedded:boolean,name:string,size_bytes:bigint,text:string>"
SCHEMA = f"path string, header_block string, parts array<{PART}>"


def _parts(message, number: str = "", embedded: bool = False):
    """Leaves of a message's tree, numbered as the protocol does; what lies inside an attached message is embedded."""
    kind = message.get_content_type()
    if message.is_multipart():
        inside = embedded or kind == "message/rfc822"
        for k, part in enumerate(message.get_payload(), 1):
            yield from _parts(part, f"{number}.{k}" if number else str(k), inside)
        return
    data = message.get_payload(decode=True) or b""
    text = data.decode(message.get_content_charset() or "utf-8", "replace") if kind.startswith("text/") else None
    yield {
        "part": number or "1", "mime_type": kind, "disposition": message.get_content_disposition(), "embedded": embedded, "name": message.get_filename(),
        "size_bytes": len(data), "text": text,
    }


def mail_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, header_block, parts) of the mail files under ``path``; a file that is no mail has no header and one part.
    Spark lists no file without bytes."""

    def read(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                head = bytes(content).replace(b"\r\n", b"\n").split(b"\n\n", 1)[0]
                rows.append((name, head.decode("utf-8", "replace"), list(_parts(message_from_bytes(bytes(content), policy=policy.compat32)))))
            yield pd.DataFrame(rows, columns=["path", "header_block", "parts"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("content")).mapInPandas(read, SCHEMA)
