"""The string rules as SQL functions, for users who write Spark SQL:

    register_sql_functions(spark)
    spark.sql("select kiln_clean_text(title) from products")

Bodies are SQL expressions (SQL user-defined functions, inlined by the
analyzer, so they stay JVM-side).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from kiln.functions.text import NON_WS_CLASS, WHITESPACE, WS_CLASS, details_sql


def _sql_chars(s: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04x}" for c in s) + "'"


def _strip(e: str) -> str:
    return f"trim(BOTH {_sql_chars(WHITESPACE)} FROM {e})"


def register_sql_functions(spark: SparkSession) -> list[str]:
    ws = _sql_chars(WHITESPACE)
    scrub = _strip("replace(replace(replace(s, '\\t', ' '), '\\n', ' '), '\\r', '')")
    clean = (f"replace(replace(s, r\"\\'\", ''), r'\\\"', '')")
    clean = (f"CASE WHEN lower({clean}) LIKE '%http%' OR lower({clean}) LIKE '%www%' "
             f"THEN regexp_replace({clean}, r'(?iu)(https?://{NON_WS_CLASS}+|www\\.{NON_WS_CLASS}+)', ' ') "
             f"ELSE {clean} END")
    clean = f"CASE WHEN contains({clean}, '<') THEN regexp_replace({clean}, r'(?d)<.*?>', ' ') ELSE {clean} END"
    clean = _strip(f"regexp_replace({clean}, r'{WS_CLASS}+', ' ')")

    def part(label, v):
        return f"CASE WHEN {v} IS NOT NULL AND trim(BOTH {ws} FROM {v}) <> '' THEN concat('{label}', {v}) END"
    text = ("concat_ws('\\n', " + ", ".join([part("Main category: ", "main_category"), part("Title: ", "title"),
                                              part("Features: ", "features"), part("Description: ", "description"),
                                              part("Details: ", "details")]) + ")")
    defs = {
        "kiln_strip": f"(s STRING) RETURNS STRING RETURN {_strip('s')}",
        "kiln_scrub": f"(s STRING) RETURNS STRING RETURN {scrub}",
        "kiln_clean_text": f"(s STRING) RETURNS STRING RETURN {clean}",
        "kiln_is_missing": f"(s STRING) RETURNS BOOLEAN RETURN coalesce({_strip('s')}, '') = ''",
        "kiln_product_text": ("(main_category STRING, title STRING, features STRING, description STRING, details STRING) "
                              f"RETURNS STRING RETURN {text}"),
        "kiln_format_details": f"(d STRING) RETURNS STRING RETURN {details_sql('d')}",
    }
    for name, body in defs.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(defs)
