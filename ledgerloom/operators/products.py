"""Which product a printed name means: the same name, the same number, nearly the same words, or a misreading - to a fixpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ledgerloom.functions.text import common_letters, numeric_signature, ocr_fold
from ledgerloom.operators import grams
from ledgerloom.operators.names import misread_costs, sure_of
from ledgerloom.sources.scratch import written
from ledgerloom.sources.ship import ship

#: Fixed value: how alike two names must be, of 100, to be one product's.
ALIKE = 94
#: The least likeness for which a name always has enough grams, and up to how many edits names meet by letters of a kind.
LOWEST, FEW = 90, 3


def sorted_words(name: Column) -> Column:
    """The words of a name in order of their code points."""
    return F.array_join(F.array_sort(F.split(F.trim(F.regexp_replace(name, r"\s+", " ")), " ")), " ")


#: What texts must agree in.
TEXT = ["supplier_id", "numbers", "s"]


def _texts(names: DataFrame) -> DataFrame:
    """``names`` (id, supplier_id, name) as they are compared: id, supplier_id, numbers, s. A null name is none."""
    rows = names.filter("name is not null").select("id", "supplier_id", F.array_join(numeric_signature(F.col("name")), "/").alias("numbers"), sorted_words(F.col("name")).alias("s"))
    return written(rows.filter("s <> ''"))


def _scored(read: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """(supplier_id, numbers, a, b, ..., score): the pairs of texts of ``read`` (supplier_id, numbers, s; each once) and ``known`` (the same,
    and what else it has) that are ``least`` or more alike."""
    if least < LOWEST:
        raise ValueError(f"names less than {LOWEST} alike may share no rare gram")
    n = F.length("s")
    # The fewest and the most edits that are asked for of a text and another of any length that may be alike.
    few, many = F.floor(2 * (100 - least) * n / (200 - least)), F.floor(2 * (100 - least) * n / least)
    # q d + 1 grams are never more than a name of d > 0 has: q 2 (100 - least) / least stays below 0.41.
    q = max(2, min(6, 19 // (100 - least) if least < 100 else 6))
    longer = lambda df: df.filter(many > FEW)
    ranks = grams.counted(longer(read.select("s")).unionByName(longer(known.select("s"))), q)

    def side(df, to):
        df = df.withColumn("n", n)
        met = grams.rarest(longer(df), ranks, q, q * many + 1).unionByName(grams.letters_by_kind(df.filter(few <= FEW), few, F.least(many, F.lit(FEW))))
        return met.withColumnsRenamed({"s": to, "odd1": f"__{to}", "n": f"__n{to}"})

    met = side(read, "a").hint("merge").join(side(known, "b"), ["gram", "supplier_id", "numbers"])
    # What is cheap comes first: most that meet differ in too many letters.
    most = (100 - least) * (F.col("__na") + F.col("__nb"))
    close = F.call_function("levenshtein", F.col("a"), F.col("b"), F.floor(most / 100).cast("int")) >= 0
    near = met.filter((100 * grams.differ(F.col("__a"), F.col("__b")) <= most) & close).drop("gram", "__a", "__b", "__na", "__nb").distinct()

    def score(batches):
        for x in batches:
            yield x.assign(score=[200.0 * common_letters(a, b) / (len(a) + len(b)) for a, b in zip(x.a, x.b, strict=True)])

    ship(read.sparkSession)
    return near.mapInPandas(score, StructType([*near.schema.fields, StructField("score", DoubleType())])).filter(F.col("score") >= least)


def alike(read: DataFrame, known: DataFrame, least: int = ALIKE) -> DataFrame:
    """(read_id, known_id, score): every pair of one supplier with the same numbers whose words, sorted, are ``least`` or more alike:
    of 200, the letters in common in order over all letters.

    A set-similarity join. A name of n letters in such a pair is at most d = 2 (100 - least) n / least insertions and deletions
    from the other. Where the pair's are at most ``FEW``, letters dealt in one kind more than that have a kind that no edit touched.
    Else each spoils at most q of its grams of q letters, so of the q d + 1 rarest grams of either name the two share one. Only
    these are joined, by supplier and numbers, and lengths, letters and plain edit distance thin the pairs out before they
    are scored. The more alike, the longer the grams. ``read`` and ``known``: id, supplier_id, name; a null name is alike to none;
    equal names are looked at once.
    """
    both = {"a": _texts(read), "b": _texts(known)}
    scored = _scored(*(written(rows.select(*TEXT).distinct()) for rows in both.values()), least)
    back = lambda s, id_: both[s].withColumnsRenamed({"id": id_, "s": s}).hint("merge")
    return scored.join(back("a", "read_id"), ["supplier_id", "numbers", "a"]).join(back("b", "known_id"), ["supplier_id", "numbers", "b"]).select("read_id", "known_id", "score")


def known_by(lines: DataFrame, products: DataFrame, least: int = ALIKE) -> DataFrame:
    """``lines`` (line_id, supplier_id, name, ean) with ``product_id`` and ``how``: of the supplier's ``products`` (product_id,
    supplier_id, name, ean) the one of the same name whatever the case (``exact``), else of the same number (``ean``), else the
    most alike (``alike``), the smaller id of several; null where none."""
    fold = F.lower(F.trim("name")).alias("fold")
    by_name = products.groupBy("supplier_id", fold).agg(F.min("product_id").alias("__exact"))
    by_number = products.filter("ean <> ''").groupBy("supplier_id", F.concat(F.lit("#"), "ean").alias("number")).agg(F.min("product_id").alias("__ean"))
    # Lines without a number are not all dealt to one task.
    number = F.when(F.col("ean") != "", F.concat(F.lit("#"), "ean")).otherwise(F.col("line_id").cast("string"))
    rows = lines.withColumn("fold", fold).join(by_name.hint("merge"), ["supplier_id", "fold"], "left").drop("fold")
    rows = written(rows.withColumn("number", number).join(by_number.hint("merge"), ["supplier_id", "number"], "left").drop("number"))
    read = _texts(rows.filter("__exact is null and __ean is null").select(F.col("line_id").alias("id"), "supplier_id", "name"))
    # Of products of one text the first will do; of lines, any.
    own = written(_texts(products.select(F.col("product_id").alias("id"), "supplier_id", "name")).groupBy(*TEXT).agg(F.min("id").alias("known_id")))
    order = F.struct(-F.col("score"), "known_id")
    best = _scored(written(read.select(*TEXT).distinct()), own, least).groupBy("supplier_id", "numbers", F.col("a").alias("s")).agg(F.min(order).alias("best"))
    found = read.join(best.hint("merge"), TEXT).groupBy(F.col("id").alias("line_id")).agg(F.min("best").getField("known_id").alias("__alike"))
    kinds = [f"__{k}" for k in ("exact", "ean", "alike")]
    how = F.coalesce(*(F.when(F.col(k).isNotNull(), k[2:]) for k in kinds))
    return rows.join(found.hint("merge"), "line_id", "left").select(*lines.columns, F.coalesce(*kinds).alias("product_id"), how.alias("how"))


def resolve(lines: DataFrame, products: DataFrame, least: int = ALIKE) -> DataFrame:
    """``known_by``, and for what is left the one product that the name is a misreading of (``misread``, with the ``round`` that
    found it; 0 for the others), else ``new`` without a product.

    Every name found is one more that its product is known by, so a spelling too far from the product's own is reached over
    others; rounds end when one finds nothing. All names of a round are looked up at once, so the order of lines is of no
    account. A null or blank name is new unless its number is known; repeated lines agree; empty tables give what they can.
    """
    found = written(known_by(lines, products, least).withColumn("round", F.when(F.col("how").isNotNull(), 0)).withColumn("fold", ocr_fold(F.col("name"))))
    names = lambda rows, fold: rows.select(F.col("product_id").alias("id"), "supplier_id", fold.alias("name"))
    known = written(names(products, ocr_fold(F.col("name"))).unionByName(names(found.filter("how is not null"), F.col("fold"))).distinct())
    done, open_, n = found.filter("how is not null"), found.filter("how is null and trim(name) <> ''"), 0
    unnamed = found.filter("how is null and coalesce(trim(name), '') = ''")
    fresh, priced = known, None
    while True:
        n += 1
        # Names of one fold are one question, under one id in all rounds; what they met before they need not meet again.
        asked = written(open_.groupBy("supplier_id", F.col("fold").alias("name")).agg(F.min("line_id").alias("id")))
        new = misread_costs(asked, fresh)
        priced = written(new if priced is None else new.unionByName(priced.join(asked.select(F.col("id").alias("read_id")).hint("merge"), "read_id", "left_semi")))
        answers = written(sure_of(priced).join(asked.hint("merge"), F.col("read_id") == F.col("id")).select("supplier_id", F.col("name").alias("fold"), F.col("known_id").alias("__p")))
        if answers.isEmpty():
            break
        met = written(open_.join(answers.hint("merge"), ["supplier_id", "fold"], "left"))
        columns = [c for c in found.columns if c not in ("product_id", "how", "round")]
        done = done.unionByName(met.filter("__p is not null").select(*columns, F.col("__p").alias("product_id"), F.lit("misread").alias("how"), F.lit(n).alias("round")))
        open_ = met.filter("__p is null").drop("__p")
        fresh = answers.select(F.col("__p").alias("id"), "supplier_id", F.col("fold").alias("name"))
    rest = open_.unionByName(unnamed).withColumn("how", F.lit("new"))
    return done.unionByName(rest).drop("fold").withColumn("round", F.coalesce("round", F.lit(0)))
