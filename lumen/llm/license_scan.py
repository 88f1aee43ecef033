"""Licence scan by canonical digests, in DataFrame operations only.

Texts are brought to a canonical form (case, punctuation, copyright lines, equivalent
spellings), hashed, and entire texts are hash-joined to the digests of known licences.
Notices, which stand as whole lines in other texts, are found the same way line by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen.llm.license_texts import LICENSES, NOTICES, long_licenses

# Spellings that mean the same in licences, after case and punctuation are gone.  Fixed values.
EQUIVALENT = [
    ("licence", "license"), ("licencing", "licensing"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("organisation", "organization"), ("favour", "favor"), ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"), ("copyright owner", "copyright holder"), ("http ", "https "),
]
COPYRIGHT = r"^(portions )?copyright (c |[0-9]{4})|^c [0-9]{4}|^all rights reserved$"
# Further copyright lines: sign or (c) beside the word, and up to eight words of a holder or placeholder.
# Lines of a licence's body may begin with "copyright" too; BODY has the words that follow it there.
BODY = ("also|and|are|as|disclaimers?|doctrines?|for|from|holders?|if|in|infringement|interests?|is|laws?|license[ds]?|like|line|may|"
        "must|notices?|of|on|or|owners?|ownership|patents?|permissions?|protect[a-z]*|related|rights?|shall|statements?|that|this|those|"
        "to|treaty|treaties|under|was|were|will|with")
HOLDER = (r"^(portions )?(copyright )+(c |[0-9]{4})|^(portions )?c (copyright )+(c )?[0-9]{4}"
          rf"|^(portions )?(c )?copyright (?!(the|{BODY})( |$))[^ ]+( [^ ]+){{0,7}}$"
          r"|^(portions )?(c )?copyright (by )?the ([^ ]+ ){1,6}(authors?|contributors?|developers?|foundation|project|team)( [0-9]{4})?( all rights reserved)?$")
MAX_NOTICES = 10_000


def canonical_line(line: Column) -> Column:
    """Lower-case words with single spaces, in one spelling; copyright lines become empty."""
    out = F.regexp_replace(F.replace(F.lower(line), F.lit("©"), F.lit(" copyright c ")), r"[^\p{L}\p{N}]+", " ")
    out = F.trim(out)
    for other, one in EQUIVALENT:
        out = F.replace(out, F.lit(other), F.lit(one))
    return F.when(out.rlike(f"{COPYRIGHT}|{HOLDER}"), F.lit("")).otherwise(out)


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text, empty ones dropped."""
    return F.filter(F.transform(F.split(text, "\n"), canonical_line), lambda x: x != "")


def _digest(lines: Column) -> Column:
    """Of the whole canonical text (none for a text without words)."""
    return F.when(F.size(lines) > 0, F.sha2(F.array_join(lines, " "), 256))


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, text) of the licences that come with the library."""
    return spark.createDataFrame(sorted(LICENSES.items()) + long_licenses(), "license_id string, text string")


def known_digests(known: DataFrame) -> DataFrame:
    """(license_digest, license_id): one row per digest, the smallest id of equal texts."""
    return (known.select("license_id", _digest(canonical_lines(F.col("text"))).alias("license_digest"))
            .where("license_digest IS NOT NULL").groupBy("license_digest").agg(F.min("license_id").alias("license_id")))


def scan(docs: DataFrame, known: DataFrame | None = None, notices: dict[str, str] = NOTICES,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_digest, license_id, n_notices, notice_ids) for every row of ``docs``.

    ``license_id`` names the known licence whose whole text the document is, in canonical
    form (null: none); ``notice_ids`` (sorted, comma-joined) the known notices that stand as
    whole lines, ``n_notices`` how many lines do.  Null texts and texts without words have
    no digest and no licence; repeated rows are scanned each; an empty table gives an empty
    result; other columns are ignored.  Notices are at most ``MAX_NOTICES`` and go into the
    plan as a map; licences are joined by digest, in whatever number.
    """
    if len(notices) > MAX_NOTICES:
        raise ValueError(f"more than {MAX_NOTICES} notices; give them as licences of their own")
    spark = docs.sparkSession
    known = known_digests(known if known is not None else known_licenses(spark))
    forms = spark.createDataFrame(sorted(notices.items()), "id string, text string").select(
        "id", F.array_join(canonical_lines(F.col("text")), " ").alias("form"), _digest(canonical_lines(F.col("text"))).alias("digest"))
    rows = forms.collect()
    sizes = F.array(*[F.lit(n) for n in sorted({len(r["form"]) for r in rows})]) if rows else F.array().cast("array<int>")
    by_digest = F.create_map(*[F.lit(x) for r in rows for x in (r["digest"], r["id"])]) if rows else None
    lined = docs.select(F.col(id_col).alias("id"), canonical_lines(F.col(text_col)).alias("lines"))
    # a line can only be a notice if it has the length of one
    alike = F.filter("lines", lambda x: F.array_contains(sizes, F.char_length(x)))
    named = F.filter(F.transform(alike, lambda x: by_digest[F.sha2(x, 256)]), lambda x: x.isNotNull()) if rows else F.array().cast("array<string>")
    scanned = lined.select("id", _digest(F.col("lines")).alias("text_digest"), F.coalesce(named, F.array().cast("array<string>")).alias("named"))
    return scanned.join(known, scanned["text_digest"] == known["license_digest"], "left").select(
        F.col("id").alias(id_col), "text_digest", "license_id", F.size("named").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct("named")), ",").alias("notice_ids"))
