"""Language tag and translation routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.functions import text as X
from ticketloom.operators.lookup import unique

SINHALA = r"\x{0D80}-\x{0DFF}"


def language_tag(
    df: DataFrame, col: str, lang: str | None = None, threshold: float = 0.5
) -> DataFrame:
    """Add ``detected_language``: Sinhala by script, else the supplied column, else ``unknown``."""
    text = F.coalesce(F.col(col), F.lit(""))
    letters = F.length(F.regexp_replace(text, rf"[^\p{{L}}{SINHALA}]+", ""))
    sinhala = F.length(F.regexp_replace(text, f"[^{SINHALA}]+", ""))
    supplied = F.col(lang) if lang else F.lit(None).cast("string")
    tag = (
        F.when((letters > 0) & (sinhala >= letters * threshold), "si")
        .when(letters == 0, "unknown")
        .otherwise(F.coalesce(supplied, F.lit("unknown")))
    )
    return df.withColumn("detected_language", tag)


def translation_route(
    df: DataFrame, col: str, translations: DataFrame | None = None, key: str = "review_id"
) -> DataFrame:
    """Add the romanised flag, the route, the source language and the text after translation.

    ``translations(key, translated)`` supplies the translated texts; a missing one is empty, as a
    failed translation is. Texts on the ``keep`` route stay.
    """
    text = F.coalesce(F.col(col), F.lit(""))
    flag = (F.col("detected_language") == "en") & X.romanised_flag(text)
    sinhala = F.col("detected_language") == "si"
    routed = df.withColumn("is_singlish", flag).withColumns({
        "route": F.when(sinhala | F.col("is_singlish"), "translate").otherwise("keep"),
        "src_lang": F.when(sinhala, "si").when(F.col("is_singlish"), "auto"),
    })
    if translations is None:
        translated = F.lit("")
    else:
        routed = routed.join(unique(translations, key, "translated"), key, "left")
        translated = F.coalesce("translated", F.lit(""))
    out = routed.withColumn(
        "translated_review", F.when(F.col("route") == "translate", translated).otherwise(text)
    )
    return out.drop("translated") if translations is not None else out
