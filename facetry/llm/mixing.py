"""Mixing sources to target weights over a tree of domains, languages and sources.

* Every leaf (source of a language of a domain) can give ``max_epochs`` times its tokens; a node can give
  what its leaves can.
* The budget goes down the tree.  Siblings share their parent's budget by weight; one that cannot use its
  share gives what it has, and its shortage goes to its siblings by weight.  Since a node's own limit counts
  all leaves below it, a shortage reaches an ancestor's siblings only when its own siblings are exhausted.
* A leaf takes whole epochs first.  Of the next epoch it takes a prefix of exactly the tokens that remain: its
  documents are ordered by a hash of seed, epoch and id, and the last one is cut.

Tokens are words ``[^\\x20\\x09-\\x0D]+``.  Everything is DataFrame functions.  Prefix sums run over hash cells of
bounded size: only the one cell per leaf in which the prefix ends is ordered document by document.

Null languages and sources are leaves named ``unknown``; null and empty texts have no tokens, and of the last
epoch they are taken if they come before the end of the prefix; repeated rows count and are taken as rows of
their own; a null id is hashed as an empty one.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.session import cut

#: Target weights of the default mixture; names that are absent weigh 1.
DOMAIN_WEIGHTS = {"crawl": 0.35, "part0": 0.2, "part1": 0.2, "part2": 0.15, "part3": 0.1, "unknown": 0.1}
LANGUAGE_WEIGHTS = {"en": 0.4, "de": 0.25, "fr": 0.2, "es": 0.15, "unknown": 0.05}
SOURCE_WEIGHTS: dict[str, float] = {}
MAX_EPOCHS = 4
SEED = "mix-1"
CELL_DOCUMENTS = 500
_WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """The large crawl ``src0`` is a domain of its own; the other sources are dealt to four by number; a name without number is its own."""
    number = F.regexp_extract(source, "([0-9]+)", 1)
    return (
        F.when(source == "src0", F.lit("crawl"))
        .when(number != "", F.concat(F.lit("part"), (number.cast("long") % 4).cast("string")))
        .otherwise(source)
    )


def _weight(name: Column, weights: Mapping[str, float]) -> Column:
    out = F.lit(1.0)
    for value, w in weights.items():
        out = F.when(name == value, F.lit(float(w))).otherwise(out)
    return out


def allocate(children: DataFrame, parent: list[str]) -> DataFrame:
    """Share ``budget`` of each parent among its children by ``weight``, none above its ``limit``; adds ``share``.

    In the order of limit over weight the children that get their whole limit come first, so running sums
    decide who they are; the others share the rest by weight.
    """
    useful = children.filter((F.col("weight") > 0) & (F.col("limit") > 0))
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("limit") / F.col("weight"), F.col("name"))
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = useful.withColumn("_before", before).withColumn("_rest", rest)
    level = level.withColumn(
        "_full", F.col("limit") * F.col("_rest") <= F.col("weight") * (F.col("budget") - F.col("_before"))
    )
    rate = F.max(F.when(~F.col("_full"), (F.col("budget") - F.col("_before")) / F.col("_rest"))).over(by)
    level = level.withColumn("_rate", rate)
    share = F.when(F.col("_full"), F.col("limit")).otherwise(F.greatest(F.col("weight") * F.col("_rate"), F.lit(0.0)))
    return level.withColumn("share", share).drop("_before", "_rest", "_full", "_rate")


def leaf_budgets(leaves: DataFrame, budget: float, weights: tuple[Mapping[str, float], ...], max_epochs: int) -> DataFrame:
    """``(*LEVELS, tokens, documents, budget)``: whole tokens for each leaf of ``(*LEVELS, tokens, documents)``."""
    limits = leaves.withColumn("limit", F.col("tokens").cast("double") * max_epochs)
    parents = None
    for depth, name in enumerate(LEVELS):
        path, above = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        level = limits.groupBy(*path).agg(F.sum("limit").alias("limit"))
        level = level.withColumn("weight", _weight(F.col(name), weights[depth])).withColumn("name", F.col(name))
        if parents is None:
            level = level.withColumn("budget", F.lit(float(budget)))
        else:
            level = level.join(parents.select(*above, F.col("share").alias("budget")), above)
        parents = allocate(level, above)
    given = parents.select(*LEVELS, F.floor(F.col("share") + 0.001).cast("long").alias("budget"))
    return leaves.join(given, list(LEVELS), "left").withColumn("budget", F.coalesce("budget", F.lit(0).cast("long")))


def mix(
    docs: DataFrame,
    budget: int | None = None,
    weights: tuple[Mapping[str, float], ...] = (DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS, SOURCE_WEIGHTS),
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    cell_documents: int = CELL_DOCUMENTS,
) -> DataFrame:
    """Per row: ``doc_id, domain, lang, source, n_tokens, epochs, prefix_tokens, in_prefix, taken_tokens``.

    ``epochs`` whole copies are taken, and of one more copy the first ``prefix_tokens`` tokens if
    ``in_prefix``.  ``budget`` defaults to all tokens there are.
    """
    unknown = F.lit("unknown")
    slim = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        domain_of(F.coalesce(F.col(source).cast("string"), unknown)).alias("domain"),
        F.coalesce(F.col(lang).cast("string"), unknown).alias("lang"),
        F.coalesce(F.col(source).cast("string"), unknown).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long").alias("n_tokens"),
    )
    slim = cut(slim)
    leaves = slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    leaves = cut(leaves)
    if budget is None:
        budget = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    plan = leaf_budgets(leaves, budget, weights, max_epochs)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", whole).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    plan = cut(
        plan.select(
            *LEVELS, "epochs", "rest", F.ceil(F.col("documents") / cell_documents).cast("long").alias("_cells")
        )
    )
    hashed = F.md5(
        F.concat_ws("-", F.lit(seed), (F.col("epochs") + 1).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    )
    rows = slim.join(plan, list(LEVELS)).withColumn("_hash", hashed)
    place = F.conv(F.substring("_hash", 1, 7), 16, 10).cast("long")
    rows = rows.withColumn("_cell", F.floor(place * F.col("_cells") / F.lit(1 << 28)).cast("long"))
    sizes = rows.groupBy(*LEVELS, "_cell").agg(F.sum("n_tokens").alias("_size"))
    earlier = Window.partitionBy(*LEVELS).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    rows = rows.join(cut(sizes), [*LEVELS, "_cell"])
    inner = F.col("_before") + F.col("_size") <= F.col("rest")
    outer = F.col("_before") >= F.col("rest")
    ends_here = rows.filter(~inner & ~outer)
    in_cell = (
        Window.partitionBy(*LEVELS, "_cell")
        .orderBy("_hash", "doc_id", "n_tokens")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ends_here = ends_here.withColumn("_start", F.col("_before") + F.coalesce(F.sum("n_tokens").over(in_cell), F.lit(0)))
    sure = rows.filter(inner | outer).withColumn("_start", F.when(inner, F.lit(-1)).otherwise(F.col("rest")).cast("long"))
    all_rows = sure.unionByName(ends_here)
    in_prefix = F.col("_start") < F.col("rest")
    prefix = (
        F.when(~in_prefix, F.lit(0))
        .when(F.col("_start") < 0, F.col("n_tokens"))
        .otherwise(F.least("n_tokens", F.col("rest") - F.col("_start")))
        .cast("long")
    )
    return all_rows.select(
        "doc_id",
        *LEVELS,
        "n_tokens",
        "epochs",
        prefix.alias("prefix_tokens"),
        in_prefix.alias("in_prefix"),
        (F.col("epochs") * F.col("n_tokens") + prefix).alias("taken_tokens"),
    )


def mixed(docs: DataFrame, size: str = "n_chars", **options) -> DataFrame:
    """The rows of ``docs`` as :func:`mix` takes them, with all columns: one row per epoch, the last one maybe cut.

    Rows that share id, source, language and number of tokens are taken alike, by the best place among them.
    """
    key, text = options.get("key", "doc_id"), options.get("text", "text")
    taken = mix(docs, **options).filter((F.col("epochs") > 0) | F.col("in_prefix"))
    same = ["doc_id", "lang", "source", "n_tokens"]
    taken = taken.groupBy(*same).agg(
        F.max("epochs").alias("_epochs"), F.max("prefix_tokens").alias("_prefix"), F.max("in_prefix").alias("_in")
    )
    unknown = F.lit("unknown")
    # the columns of ``docs`` travel under numbers, so that no name can clash with those used here
    names = docs.columns
    at = {c: f"c{i}" for i, c in enumerate(names)}
    mine = docs.toDF(*at.values())
    body = F.col(at[text])
    mine = mine.select(
        "*",
        F.col(at[key]).cast("long").alias("k0"),
        F.coalesce(F.col(at[options.get("lang", "lang")]).cast("string"), unknown).alias("k1"),
        F.coalesce(F.col(at[options.get("source", "source")]).cast("string"), unknown).alias("k2"),
        F.coalesce(F.regexp_count(body, F.lit(_WORD)), F.lit(0)).cast("long").alias("k3"),
    )
    taken = taken.select(*[F.col(c).alias(f"t{i}") for i, c in enumerate(same)], "_epochs", "_prefix", "_in")
    rows = mine.join(taken, [F.col(f"k{i}").eqNullSafe(F.col(f"t{i}")) for i in range(4)])
    copies = F.col("_epochs") + F.when(F.col("_in"), 1).otherwise(0)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    part = (F.col("copy") > F.col("_epochs")) & (F.col("_prefix") < F.col("k3"))
    rows = rows.withColumn(at[text], F.when(part, first_tokens(body, F.col("_prefix"))).otherwise(body))
    if size in at:
        rows = rows.withColumn(at[size], F.length(at[text]).cast(docs.schema[size].dataType))
    return rows.select(*at.values()).toDF(*names)


def first_tokens(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    steps = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(steps, F.lit(1), n.cast("int")), "")


def _case(name: str, weights: Mapping[str, float]) -> str:
    return "CASE " + "".join(f"WHEN {name} = '{k}' THEN {v!r} " for k, v in weights.items()) + "ELSE 1.0 END" if weights else "1.0"


def _level_sql(depth: int, weights: Mapping[str, float]) -> str:
    path, above, name = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth]), LEVELS[depth]
    by = f"PARTITION BY {above} " if above else ""
    source = (
        f"(SELECT {path}, sum(lim) AS lim, any_value(b) AS budget FROM (SELECT *, CAST(tokens AS DOUBLE) * {MAX_EPOCHS} AS lim, "
        f"(SELECT CAST(sum(tokens) AS DOUBLE) FROM leaves) AS b FROM leaves) GROUP BY {path})"
        if depth == 0
        else f"(SELECT c.*, p.share AS budget FROM (SELECT {path}, sum(CAST(tokens AS DOUBLE) * {MAX_EPOCHS}) AS lim FROM leaves "
        f"GROUP BY {path}) c JOIN level{depth - 1} p USING ({above}))"
    )
    return f"""
level{depth} AS (
  SELECT *, CASE WHEN is_full THEN lim ELSE greatest(w * max(CASE WHEN NOT is_full THEN (budget - bef) / rst END) OVER ({by}), 0.0) END AS share
  FROM (
    SELECT *, lim * rst <= w * (budget - bef) AS is_full
    FROM (
      SELECT *,
        coalesce(sum(lim) OVER ({by}ORDER BY lim / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS bef,
        sum(w) OVER ({by}ORDER BY lim / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rst
      FROM (SELECT *, CAST({_case(name, weights)} AS DOUBLE) AS w FROM {source}) WHERE w > 0 AND lim > 0)))"""


ORACLE_SQL = f"""
WITH named AS (
  SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens
  FROM documents),
docs AS (
  SELECT *, CASE WHEN source = 'src0' THEN 'crawl' WHEN regexp_extract(source, '([0-9]+)', 1) <> ''
    THEN 'part' || CAST(CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) % 4 AS VARCHAR) ELSE source END AS domain
  FROM named),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM docs GROUP BY domain, lang, source),
{_level_sql(0, DOMAIN_WEIGHTS)},
{_level_sql(1, LANGUAGE_WEIGHTS)},
{_level_sql(2, SOURCE_WEIGHTS)},
plan AS (
  SELECT *, CAST(CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS BIGINT) AS epochs
  FROM (SELECT l.domain, l.lang, l.source, CAST(l.tokens AS BIGINT) AS tokens, coalesce(CAST(floor(s.share + 0.001) AS BIGINT), 0) AS budget
    FROM leaves l LEFT JOIN level2 s USING (domain, lang, source))),
placed AS (
  SELECT d.*, p.epochs, p.budget - p.epochs * p.tokens AS rest,
    CAST(coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
      ORDER BY md5(concat_ws('-', '{SEED}', CAST(p.epochs + 1 AS VARCHAR), CAST(doc_id AS VARCHAR))), doc_id, n_tokens
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM docs d JOIN plan p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, epochs,
  CASE WHEN start < rest THEN least(n_tokens, rest - start) ELSE 0 END AS prefix_tokens,
  start < rest AS in_prefix,
  epochs * n_tokens + CASE WHEN start < rest THEN least(n_tokens, rest - start) ELSE 0 END AS taken_tokens
FROM placed
"""
