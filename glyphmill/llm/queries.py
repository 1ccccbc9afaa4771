"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import read_table
from . import bpe, fingerprint, html_extract, licenses, line_dedup, minhash, outliers, packing, pii, warc

Query = Callable[[SparkSession, str], DataFrame]


def _on(table: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(read_table(spark, sf_dir, table))


QUERIES: dict[str, Query] = {
    "op1_robust_outliers": _on("documents", outliers.regular),
    "op2_minhash_near_duplicates": _on("documents", minhash.near_duplicates),
    "op3_line_dedup": _on("documents", lambda docs: line_dedup.deduplicate(docs.select("doc_id", "text"), count="n_removed")),
    "op4_html_extraction": _on("pages", html_extract.extract_pages),
    "op5_license_scan": _on("documents", licenses.scan),
    "op6_multiset_fingerprints": _on("documents", fingerprint.fingerprints),
    "op7_byte_bpe": _on("documents", bpe.encode_documents),
    "op8_warc_normaliser": _on("pages", warc.normalise_pages),
    "op9_best_fit_packing": _on("documents", packing.pack),
    "op10_pii_redaction": _on("documents", lambda docs: pii.redact_documents(docs.select("doc_id", "text"), kinds="kinds")),
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": line_dedup.deduplicate_sql(),
    "op5_license_scan": licenses.scan_sql(),
    "op6_multiset_fingerprints": fingerprint.FINGERPRINT_SQL,
}
