"""Numbers of lexemes for lemmas that are written differently in text and lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.tables import few, written

# Endings that go for one another, in order, and spellings.
ENDINGS = [
    ("εομαι", "εω"), ("αομαι", "αω"), ("οομαι", "οω"), ("ομαι", "ω"), ("ιθεμαι", "ιθημι"), ("ισταμαι", "ιστημι"), ("ιεμαι", "ιημι"), ("οδομαι", "ιδωμι"),
    ("υμαι", "υμι"), ("αμαι", "ημι"), ("εμαι", "ημι"), ("υμι", "υω"), ("υω", "υμι"), ("ημι", "αω"), ("ημι", "εω"), ("ωμι", "οω"), ("ω", "ομαι"), ("ουσ", "εοσ"), ("αρχησ", "αρχοσ"),
]
SPELLINGS = {"τεσσερακοντα": "τεσσαρακοντα", "ενεκεν": "ενεκα", "μαριαμ": "μαρια"}
#: Numbers above this are additions to the classical list.
CLASSICAL = 5_624


def variants(norm: Column) -> Column:
    """Array of (how, form) to be tried for a folded lemma, in order: letters in brackets with and without, spellings, other endings."""
    optional = F.contains(norm, F.lit("("))
    bases = F.when(optional, F.array(F.regexp_replace(norm, r"\(([^)]*)\)", "$1"), F.regexp_replace(norm, r"\([^)]*\)", ""))).otherwise(F.array(norm))
    named = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])

    def changed(base: Column) -> Column:
        ends = [F.when(F.endswith(base, F.lit(a)), F.concat(F.left(base, F.length(base) - len(a)), F.lit(b))) for a, b in ENDINGS]
        return F.array(named[base], *ends)

    every = F.concat(F.filter(bases, lambda b: b != norm), F.flatten(F.transform(bases, changed)))
    tried = F.filter(every, lambda v: v.isNotNull())
    return F.transform(tried, lambda v, i: F.struct((i + 2).alias("how"), v.alias("form")))


def lemma_numbers(lemmas: DataFrame, lexemes: DataFrame) -> DataFrame:
    """lemma, norm, strong, how of the distinct ``lemmas`` (lemma, norm), by ``lexemes`` (strong, lemma, norm).

    The lemma as written decides (how = 0), else its folded form (1), else the first variant that the lexicon has (2 on); of several
    numbers classical ones come first, then lower ones. A lexeme may list several forms between commas or signs of equality. Without a
    number the lemma stays with a null.
    """

    def forms(column: str) -> DataFrame:
        each = lexemes.select("strong", F.explode(F.split(column, "[,=]")).alias("form")).select("strong", F.trim("form").alias("form")).filter("form <> ''")
        number = F.coalesce(F.regexp_extract("strong", r"^[GH]0*([0-9]{1,9})", 1).try_cast("long"), F.lit(1_000_000).cast("long"))
        rank = F.struct((number > CLASSICAL).alias("later"), number.alias("number"), F.col("strong").alias("strong"))
        best = written(each.groupBy("form").agg(F.min(rank)["strong"].alias("strong")), "forms")
        return F.broadcast(best) if few(best) else best

    once = written(lemmas.select("lemma", "norm").filter("lemma IS NOT NULL AND lemma <> ''").distinct(), "lemmas")
    exact = once.select("lemma", "norm", F.lit(0).alias("how"), F.col("lemma").alias("form")).join(forms("lemma"), "form")
    tried = F.concat(F.array(F.struct(F.lit(1).alias("how"), F.col("norm").alias("form"))), variants(F.col("norm")))
    other = once.filter("norm IS NOT NULL").select("lemma", "norm", F.explode(tried).alias("v")).select("lemma", "norm", "v.how", "v.form").join(forms("norm"), "form")
    best = exact.unionByName(other).groupBy("lemma", "norm").agg(F.min(F.struct("how", "strong")).alias("b"))
    own = best.select(F.col("lemma").alias("_l"), F.col("norm").alias("_n"), "b")
    return once.join(own, (F.col("lemma") == F.col("_l")) & F.col("norm").eqNullSafe(F.col("_n")), "left").select("lemma", "norm", "b.strong", "b.how")
