"""Fill-in-middle transformation by counted quantifiers (operator 11).

``regexp_count`` gives the number n of units (code points) of a text.  Two
numbers drawn from the id cut it into prefix, middle and suffix: a pattern of
possessive groups ``(.{a}+)(.{b-a}+)(.*+)``, made for each row, captures the
three in one match, and the replacement text puts them in the order of the
row's form.  Possessive groups never give back what they took, so the match
is one linear walk and needs no stack, whatever the length.

Forms: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` is
<S>suffix<P>prefix<M>middle, ``plain`` is the text itself.  A text that
holds a mark is always plain, so that a mark found in an output is the
transformation's own: ``restore`` rebuilds the text from output and form.

The work is one projection without a shuffle; each row is transformed where
it is read, so neither hot sources nor groups of copies matter.

Defined results: null text counts as '' and stays plain, as does ''; a null
id is drawn as the empty text; equal (id, text) rows get equal outputs; units
beyond the basic plane count as one; an empty table gives an empty frame.
Input columns named like an output column (in any case) are replaced; all
others pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starledger.llm.common import text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
PLAIN_FROM = 90  # of 100 draws, those from here on stay plain
SPM_BELOW = 20   # of 100 draws, those below are spm
BLOCK = 1024
OUTPUTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def units(text: Column) -> Column:
    """bigint: code points of ``text``.

    Whole blocks are counted first and what they leave unit by unit, as the
    count holds one array entry for each match.
    """
    rest = F.regexp_replace(text, F.lit(rf"(?s)\A(?:.{{{BLOCK}}}+)*+"), F.lit(""))
    return (F.regexp_count(text, F.lit(f"(?s).{{{BLOCK}}}+")).cast("bigint") * BLOCK
            + F.regexp_count(rest, F.lit("(?s).")).cast("bigint"))


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 from the hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def has_mark(text: Column) -> Column:
    return text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)


def arrange(text: Column, form: Column, before: Column, middle: Column) -> Column:
    """The output: one match of the row's own pattern."""
    pattern = F.concat(F.lit(r"(?s)\A(.{"), before.cast("string"), F.lit("}+)(.{"), middle.cast("string"), F.lit(r"}+)(.*+)\z"))
    order = (F.when(form == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
             .when(form == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"))
    return F.when(form == "plain", text).otherwise(F.regexp_replace(text, pattern, order))


def restore(output: Column, form: Column) -> Column:
    """The text, from the output and its form alone."""
    psm = F.regexp_replace(output, F.lit(rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*+)\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*+)\z"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transform(docs: DataFrame, seed: int = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars (null if plain) and output."""
    rest = [c for c in docs.columns if c.lower() not in OUTPUTS and c not in (id_col, text_col)]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(None)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("given"), text_or_empty(text_col).alias("text"), row.alias("rest"))
    d = d.withColumn("n", units(F.col("text"))).withColumn("h", F.array(*draws(F.col("id"), seed)))
    one, two, three, four = (F.get("h", F.lit(i)) for i in range(4))
    cut_a, cut_b = one % (F.col("n") + 1), two % (F.col("n") + 1)
    plain = (F.col("n") == 0) | has_mark(F.col("text")) | (three % 100 >= plain_from)
    d = d.select("id", "given", "text", "rest", "n", F.least(cut_a, cut_b).alias("a"), F.greatest(cut_a, cut_b).alias("b"),
                 F.when(plain, "plain").when(four % 100 < spm_below, "spm").otherwise("psm").alias("form"))
    inside = F.col("form") != "plain"
    return d.select(
        F.col("id").alias(id_col), F.col("given").alias(text_col), *[F.col("rest").getField(c).alias(c) for c in rest],
        "n", "form", F.when(inside, F.col("a")).alias("prefix_chars"), F.when(inside, F.col("b") - F.col("a")).alias("middle_chars"),
        arrange(F.col("text"), F.col("form"), F.col("a"), F.col("b") - F.col("a")).alias("output"))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    done = transform(docs.select("doc_id", "text"))

    def sha(c: Column) -> Column:
        return F.sha2(c.cast("binary"), 256)
    return done.select(F.col("doc_id").cast("bigint").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
                       sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
),
k AS (
  SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d
),
f AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM k
),
p AS (
  SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
