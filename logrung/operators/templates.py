"""Template mining and matching on masked messages.

After He et al., "Drain: An Online Log Parsing Approach with Fixed Depth Tree"
(ICWS 2017): messages are split by token count and leading tokens, then merged
by token similarity within such a leaf (``template_mining``). Mining runs on
distinct messages with counts, so a message that makes up a third of the log is
one row. Matching files each template under one of its tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logrung.functions.text import strip
from logrung.operators.template_mining import WILDCARD, Bounds, grown_templates
from logrung.session import landed

# Miss marker and the published defaults of the method.
UNMATCHED = "<UNKNOWN_FORMAT>"
SIMILARITY = 0.4
MAX_CHILDREN = 100

TEMPLATE_COLUMNS = ["template_id", "template", "n_tokens", "messages", "rows", "is_new"]


def spaced(message: Column) -> Column:
    """The message with its tokens set apart by one blank."""
    return F.regexp_replace(strip(message), r"(?U)[\s\x1c-\x1f]+", " ")


def distinct_messages(df: DataFrame, message: str = "masked") -> DataFrame:
    """(text, rows): distinct non-empty messages with their row counts."""
    return (
        df.filter(F.col(message) != "")
        .groupBy(spaced(F.col(message)).alias("text"))
        .agg(F.count("*").alias("rows"))
        .filter("text != ''")
    )


def _branch_columns(rows: DataFrame) -> DataFrame:
    """Adds the token count and the first token, a wildcard if it has a digit."""
    tokens = F.split("text", " ")
    own = F.when(tokens[0].rlike(r"\d"), F.lit(WILDCARD)).otherwise(tokens[0])
    return rows.withColumn("_width", F.size(tokens)).withColumn("_token", own)


def _branches(messages: DataFrame, max_children: int) -> DataFrame:
    """(_width, _token): first tokens that have a branch of their own, the heaviest of each token count."""
    w = Window.partitionBy("_width").orderBy(F.col("_weight").desc(), "_token")
    branches = (
        _branch_columns(messages)
        .groupBy("_width", "_token")
        .agg(F.sum("rows").alias("_weight"))
        .withColumn("_place", F.row_number().over(w))
        .filter(F.col("_place") < max_children)
        .select("_width", "_token", F.lit(True).alias("_kept"))
    )
    return landed(branches, "template-branches")


def _in_leaves(messages: DataFrame, branches: DataFrame) -> DataFrame:
    """(leaf, text, rows): the leaf is the token count and the branch; all other first tokens share the wildcard's."""
    branch = F.when(F.col("_kept"), F.col("_token")).otherwise(F.lit(WILDCARD))
    # "\x02" begins a branch name; it cannot occur inside a token.
    leaf = F.concat(F.col("_width").cast("string"), F.lit("\x02"), branch)
    return _branch_columns(messages).join(branches, ["_width", "_token"], "left").select(leaf.alias("leaf"), "text", "rows")


def mine_templates(
    df: DataFrame,
    message: str = "masked",
    stored: DataFrame | None = None,
    similarity: float = SIMILARITY,
    max_children: int = MAX_CHILDREN,
    bounds: Bounds | None = None,
) -> DataFrame:
    """Mine templates from masked messages; empty messages are skipped.

    (template_id, template, n_tokens, messages, rows, is_new): distinct
    messages and rows that each template took. The result depends on the set
    of messages and their counts only, not on order, partitions or ``bounds``,
    the sizes of tasks.

    With ``stored`` templates (template, rows) training continues. A message
    that a stored template takes as it stands is counted there. One that is
    similar to it in its leaf makes it more general: the stored template keeps
    its counts under the new text. Both have ``is_new`` false; only what is
    like no stored template is mined anew. Rows of stored templates are united
    with the new ones; ``messages`` counts those of this run.
    """
    messages = landed(distinct_messages(df, message), "distinct-messages")
    seeds = None
    if stored is not None:
        seeds = landed(
            stored.groupBy(F.col("template").alias("text")).agg(F.sum("rows").alias("rows")), "stored-templates"
        )
    branches = _branches(messages if seeds is None else messages.unionByName(seeds), max_children)
    if seeds is None:
        grown = grown_templates(_in_leaves(messages, branches), None, similarity, bounds)
        every = grown.select("template", "messages", "rows", "is_new")
    else:
        known = seeds.select(F.xxhash64("text").alias("template_id"), F.col("text").alias("template"))
        taken = landed(match_messages(messages, known).select("text", "template"), "taken-messages")
        misses = messages.join(taken, "text", "left_anti")
        grown = landed(
            grown_templates(_in_leaves(misses, branches), _in_leaves(seeds, branches), similarity, bounds), "grown"
        )
        old = seeds.select(F.col("text").alias("was"), F.lit(0).cast("long").alias("messages"), "rows").unionByName(
            messages.join(taken, "text").groupBy(F.col("template").alias("was")).agg(
                F.count("*").alias("messages"), F.sum("rows").alias("rows")
            )
        )
        changed = grown.where("was IS NOT NULL").select("was", "template")
        every = grown.select("template", "messages", "rows", "is_new").unionByName(
            old.join(changed, "was", "left").select(
                F.coalesce("template", "was").alias("template"), "messages", "rows", F.lit(False).alias("is_new")
            )
        )
    united = every.groupBy("template").agg(
        F.sum("messages").alias("messages"), F.sum("rows").alias("rows"), F.min("is_new").alias("is_new")
    )
    n_tokens = F.size(F.split("template", " "))
    return united.select(
        F.xxhash64("template").alias("template_id"), "template", n_tokens.alias("n_tokens"), "messages", "rows", "is_new"
    )


def _keys(words: Column, fixed_only: bool) -> Column:
    """Hashes of (width, place, token); wildcards have none in a template."""
    width = F.size(words)
    keys = F.transform(words, lambda w, i: F.when(w != WILDCARD, F.xxhash64(width, i, w)) if fixed_only else F.xxhash64(width, i, w))
    return F.filter(keys, lambda k: k.isNotNull())


def match_messages(messages: DataFrame, templates: DataFrame) -> DataFrame:
    """(text, template_id, template) for each distinct message that matches.

    A template takes a message when all its fixed tokens agree. Each template
    is filed under the one of its (place, token) keys that fewest messages
    have, and messages look their keys up by equality, so there are at most as
    many probes as tokens, one more for templates without fixed tokens, and as
    few candidates as one key for each template allows. Candidates are
    verified token by token. The fewest wildcards win, then the smaller id.
    """
    words = F.split("template", " ")
    known = landed(templates.select("template_id", "template").withColumn("words", words), "template-known")
    of_width = F.array(F.xxhash64(F.size("words"), F.lit(-1), F.lit("")))
    fixed = _keys(F.col("words"), True)
    keys = known.select("template_id", F.explode(F.when(F.size(fixed) > 0, fixed).otherwise(of_width)).alias("key"))
    texts = landed(messages.select(F.monotonically_increasing_id().alias("message"), "text"), "message-texts")
    split = texts.withColumn("words", F.split("text", " "))
    probes = split.select("message", F.explode(F.concat(_keys(F.col("words"), False), of_width)).alias("key"))
    met = probes.join(keys.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("times"))
    # A template with a key that no message has takes none.
    rarest = F.min_by("key", F.struct(F.coalesce("times", F.lit(0)), "key")).alias("key")
    anchors = landed(keys.join(met, "key", "left").groupBy("template_id").agg(rarest), "template-anchors")
    fits = F.forall(F.zip_with("words", "known_words", lambda w, t: (t == WILDCARD) | t.eqNullSafe(w)), lambda x: x)
    stars = F.size(F.filter("known_words", lambda t: t == WILDCARD))
    hits = (
        probes.join(anchors, "key")
        .select("message", "template_id")
        .join(known.withColumnRenamed("words", "known_words"), "template_id")
        .join(split, "message")
        .where((F.size("words") == F.size("known_words")) & fits)
        .select("message", "text", F.struct(stars.alias("stars"), "template_id", "template").alias("hit"))
    )
    best = hits.groupBy("message").agg(F.first("text").alias("text"), F.min("hit").alias("hit"))
    return best.select("text", "hit.template_id", "hit.template")


def match_templates(df: DataFrame, templates: DataFrame, message: str = "masked") -> DataFrame:
    """Append template and matched; a miss has the miss marker as template.

    ``df`` is read twice, once for its distinct messages: land it first when
    the mask is not stored yet.
    """
    rows = df.withColumn("_text", spaced(F.col(message)))
    found = match_messages(distinct_messages(df, message), templates).select(
        F.col("text").alias("_text"), "template_id", "template"
    )
    # Written: when the distinct messages are few the rows need no shuffle.
    found = landed(found, "matched-messages")
    return (
        rows.join(found, "_text", "left")
        .withColumn("matched", F.col("template").isNotNull())
        .withColumn("template", F.coalesce("template", F.lit(UNMATCHED)))
        .drop("_text")
    )


def ml_input_text(template: Column, matched: Column, masked: Column) -> Column:
    """Template text when matched, else the masked message."""
    return F.when(matched, template).otherwise(masked)


def template_coverage(matched: DataFrame, message: str = "masked") -> DataFrame:
    """(matched, unmatched) over non-empty messages."""
    return matched.filter(F.col(message) != "").agg(
        F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched")
    )


def template_totals(templates: DataFrame) -> DataFrame:
    """(messages, templates): rows processed and templates known."""
    return templates.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("messages"), F.count("*").alias("templates")
    )
