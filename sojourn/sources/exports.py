"""File sinks of the exports. Every task writes its own part; nothing passes the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Header of the bookings report.
REPORT_HEADER = ("Booking Number", "Customer Name", "Tour", "Total Price", "Status", "Booked At")


def sink_csv(df: DataFrame, path: str, max_rows_per_file: int = 5_000_000) -> None:
    """Header line, quoted text, doubled quotes inside it, nothing for null."""
    (
        df.write.mode("errorifexists")
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("nullValue", None)
        .option("emptyValue", "")
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .option("maxRecordsPerFile", max_rows_per_file)
        .csv(path)
    )


def sink_json(df: DataFrame, path: str, max_rows_per_file: int = 5_000_000) -> None:
    """One JSON object per line; nulls are kept."""
    (
        df.write.mode("errorifexists")
        .option("ignoreNullFields", False)
        .option("maxRecordsPerFile", max_rows_per_file)
        .json(path)
    )


def sink_report(report: DataFrame, path: str) -> None:
    """The bookings report (``bookings.report_bookings``) as CSV under its printed header."""
    sink_csv(report.toDF(*REPORT_HEADER), path)
