"""License scans: canonical digests of whole texts, hash-joined to those of known licences.

Only DataFrame functions run here. The same steps are also written as DuckDB SQL, for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.license_texts import DIGESTS, LICENSES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines that only say who holds the rights, after lower-casing: a mark or a year must follow the word, or the phrase on all
#: rights, so that a line of the licence's own that happens to begin with the word, by wrapping, is none.
HOLDER = (
    r"^[^a-z0-9\n]*(?:copyright[^a-z0-9\n]*(?:\(c\)|c\)|©|<|\[|[0-9])[^\n]*|copyright[^\n]*all[ \t]+rights[ \t]+reserved[^a-z0-9\n]*"
    r"|\(c\)[^a-z0-9\n]*(?:copyright|[0-9])[^\n]*|©[^\n]*|all[ \t]+rights[ \t]+reserved[^a-z0-9\n]*)$"
)
#: ASCII punctuation, control characters and white space, and the usual typographic marks.
MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{2010}-\x{2027}\x{00A0}\x{00A9}\x{00AB}\x{00BB}]+"
#: Spellings that count as the same, longest first, on text of words with single spaces.
SAME = [
    ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"), ("authorised", "authorized"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("copyright owner", "copyright holder"),
    ("favour", "favor"), ("fulfil ", "fulfill "), ("initialise", "initialize"), ("judgement", "judgment"), ("labelled", "labeled"), ("labour", "labor"), ("licence", "license"), ("merchantibility", "merchantability"),
    ("modelled", "modeled"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("optimise", "optimize"), ("organisation", "organization"), ("per cent", "percent"), ("programme ", "program "),
    ("recognise", "recognize"), ("sub license", "sublicense"), ("sub licensable", "sublicensable"), ("utilise", "utilize"), ("whilst", "while"), ("wilful ", "willful "), ("https ", "http "),
]


def canonical(text: Column) -> Column:
    """Lower case, without lines on who holds the rights, words with single spaces, one spelling each; null is empty."""
    out = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    out = F.regexp_replace(out, "(?md)" + HOLDER, "")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, MARKS, " ")), F.lit(" "))
    for old, new in SAME:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(out)


def canonical_sql(text: str) -> str:
    """canonical() in DuckDB's SQL."""
    out = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    out = f"regexp_replace({out}, '(?m){HOLDER}', '', 'g')"
    out = f"' ' || trim(regexp_replace({out}, '{MARKS}', ' ', 'g')) || ' '"
    for old, new in SAME:
        out = f"replace({out}, '{old}', '{new}')"
    return f"trim({out})"


def known(spark, licenses: dict[str, str] | None = None) -> DataFrame:
    """(license_digest, license_id) of known licence texts, by default those of license_texts and the digests kept there; of
    texts that come out alike the first name is kept."""
    rows = [F.struct(F.lit(k).alias("license_id"), F.lit(v).alias("t")) for k, v in (licenses or LICENSES).items()]
    out = spark.range(1).select(F.inline(F.array(*rows)))
    out = out.select(F.sha2(canonical(F.col("t")), 256).alias("license_digest"), "license_id")
    if licenses is None:
        kept = [F.struct(F.lit(k).alias("license_digest"), F.lit(v).alias("license_id")) for k, v in DIGESTS.items()]
        out = out.union(spark.range(1).select(F.inline(F.array(*kept))))
    return out.groupBy("license_digest").agg(F.min("license_id").alias("license_id"))


def scan(documents: DataFrame, text: str = "text", licenses: dict[str, str] | None = None) -> DataFrame:
    """Adds license_digest (of the whole canonical text) and license_id (null where no known licence has that digest).

    Columns of these names are replaced. Null and empty texts have the digest of nothing, which is no licence; repeated rows
    are judged alike. The known side has a row for each licence in the list given, so its size is bound by the program
    itself and it may be broadcast; documents aren't shuffled.
    """
    spark = documents.sparkSession
    out = documents.drop("license_digest", "license_id").withColumn("license_digest", F.sha2(canonical(F.col(text)), 256))
    return out.join(F.broadcast(known(spark, licenses)), "license_digest", "left")
