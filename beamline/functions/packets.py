"""Fields of transport packets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def octet(column: str, at: int) -> Column:
    """A byte of a binary column as a number."""
    return F.conv(F.hex(F.substring(column, at + 1, 1)), 16, 10).cast("int")


def payloads(packets: DataFrame) -> DataFrame:
    """``packets(stream_id, pid, seq, pkt, ...)`` with ``tei, start, afc, cc, scrambling``
    and the payload ``data``, null where there is none."""
    rows = packets.withColumns({"_1": octet("pkt", 1), "_3": octet("pkt", 3), "_4": octet("pkt", 4)})
    afc = F.shiftright("_3", 4).bitwiseAND(F.lit(3))
    begin = F.when(afc == 1, 4).when(afc == 3, F.col("_4") + 5).otherwise(188)
    return rows.withColumns({
        "tei": F.col("_1") >= 128, "start": F.col("_1").bitwiseAND(F.lit(64)) > 0, "afc": afc, "cc": F.col("_3").bitwiseAND(F.lit(15)), "scrambling": F.shiftright("_3", 6),
        "data": F.when(begin < 188, F.substring("pkt", begin + 1, F.lit(188))),
    }).drop("_1", "_3", "_4")
