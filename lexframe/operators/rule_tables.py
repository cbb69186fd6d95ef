"""Rules as a table: the first listed name that a text contains, for lists too long for an expression.

Texts are cut at characters of kinds that no name has, as no match crosses one, and equal pieces are looked through
once. The table is matched like a trie of two levels. Level one knows the first characters of the names (their head)
and, per head, the lengths of the names that start so; level two knows the names. Every place of a piece asks
level one with its head, and level two only for the lengths it was told, both by equality. A text costs its own
length, whatever the number of names; which side of a join travels is left to Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as defaults
from ..functions import collapse_space, squeeze
from ..functions.articles import ARTICLE_MENTION
from ..session import pin

HEAD_CHARS = 3
LONG_HEAD_CHARS = 8
BLOCK_CHARS = 512
# Kinds of characters: every character is of one of them.
KINDS = ["Lu", "Ll", "Lt", "Lm", "Lo", "M", "N", "P", "S", "Z", "C"]
RULES = "view string, name string, priority bigint, value string"


def rule_table(spark: SparkSession, view: str, listed: list[tuple[list[str], str]], first: int = 0) -> DataFrame:
    """(names, value) pairs as a table; pairs rank in their order from ``first`` on."""
    rows = [
        (view, name, first + place, value) for place, (names, value) in enumerate(listed) for name in names
    ]
    return spark.createDataFrame(rows, RULES)


def _pieces(texts: DataFrame, key: str, shapes) -> DataFrame:
    """``key, view, piece``: the runs of every view between characters of kinds that no name of the view has. Pieces
    shorter than its shortest name are left out, and repeated ones of a row."""

    def runs(shape) -> Column:
        text, absent = F.col(shape["view"]), [kind for kind in KINDS if not shape[kind]]
        cut = F.split(text, "[" + "".join(rf"\p{{{kind}}}" for kind in absent) + "]+") if absent else F.array(text)
        long = F.array_distinct(F.filter(cut, lambda piece: F.char_length(piece) >= shape["shortest"]))
        return F.struct(F.lit(shape["view"]).alias("view"), long.alias("pieces"))

    seen = texts.select(key, F.explode(F.array(*map(runs, shapes))).alias("v"))
    return seen.select(key, "v.view", F.explode("v.pieces").alias("piece"))


def _blocks(pieces: DataFrame, longest: int, block_chars: int) -> DataFrame:
    """``id, block, view, n, text``: every piece in blocks of ``n`` places, with the characters that names starting there
    may need, so that no place is looked for from the start of a long text."""
    size = max(block_chars, longest)
    cut = pieces.select("id", "view", F.regexp_extract_all("piece", F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("blocks"))
    after = F.concat(F.slice("blocks", 2, F.greatest(F.size("blocks"), F.lit(1))), F.array(F.lit("")))
    joined = F.zip_with("blocks", after, lambda block, rest: F.struct(
        F.char_length(block).alias("n"), F.concat(block, F.substring(rest, 1, longest - 1)).alias("text")
    ))
    return cut.where(F.size("blocks") > 0).select("id", "view", F.posexplode(joined).alias("block", "b")).select(
        "id", "block", "view", "b.n", "b.text")


def match_rules(
    texts: DataFrame, rules: DataFrame, key: str, head_chars: int = HEAD_CHARS, block_chars: int = BLOCK_CHARS,
    long_head_chars: int = LONG_HEAD_CHARS,
) -> DataFrame:
    """``key, priority, name, value`` of the first rule whose name a text contains; no row where none does.

    ``rules`` has ``view, name, priority, value``; ``view`` names the column of ``texts`` that the name is looked for
    in. Lower priorities win, then lesser names, then lesser values. Names and texts are compared as they are. Null or
    empty names, and rules without a view or priority, match nothing; neither does a null or empty text. ``key``
    identifies a text: rows with equal keys count as parts of one text, rows with a null key are left out. Heads are
    as long as the shortest name, from ``head_chars`` to ``long_head_chars``; a name below that is its own head.
    """
    valid = rules.select("view", "name", F.col("priority").cast("bigint").alias("priority"), "value").where(
        (F.char_length("name") > 0) & F.col("view").isNotNull() & F.col("priority").isNotNull()
    )
    names = pin(
        valid.groupBy("view", "name").agg(F.min(F.struct("priority", F.coalesce("value", F.lit(""))
                                                         .alias("order"), "value")).alias("rule"))
        .select("view", "name", "rule.priority", "rule.value", F.char_length("name").alias("length")),
        "rules",
    )
    # a row per view, which are columns
    shapes = names.groupBy("view").agg(
        F.min("length").alias("shortest"), F.max("length").alias("longest"),
        *[F.max(F.col("name").rlike(rf"\p{{{kind}}}")).alias(kind) for kind in KINDS],
    ).collect()
    out = f"{key}, priority, name, value".split(", ")
    if not shapes:
        empty = texts.select(key).where(F.lit(False)).crossJoin(names.select(*out[1:]).limit(0))
        return empty.select(*out)
    shortest, longest = min(s["shortest"] for s in shapes), max(s["longest"] for s in shapes)
    head_chars = max(head_chars, min(shortest, long_head_chars))
    heads = pin(
        names.groupBy("view", F.left("name", F.lit(head_chars)).alias("head")).agg(
            F.sort_array(F.collect_set("length")).alias("lengths")
        ), "rule-heads",
    )

    pieces = pin(_pieces(texts.where(F.col(key).isNotNull()), key, shapes), "rule-pieces")
    # written, so that the numbers are the same whenever they are read
    numbered = pin(pieces.select("view", "piece").distinct().withColumn("id", F.monotonically_increasing_id()), "rule-texts")
    blocks = _blocks(numbered, longest, block_chars)
    places = blocks.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("at"))
    asked = places.select("id", "block", "view", "at", F.explode(F.array_distinct(F.array(
        *[F.col("text").substr(F.col("at"), F.lit(n)) for n in range(min(shortest, head_chars), head_chars + 1)]
    ))).alias("head"))
    told = asked.join(heads, ["view", "head"]).select("id", "block", "at", "lengths")
    read = told.join(blocks, ["id", "block"]).select(
        "id", "view", F.col("text").substr(F.col("at"), F.lit(longest)).alias("window"), F.explode("lengths").alias("length")
    )
    fits = read.where(F.char_length("window") >= F.col("length")).select(
        "id", "view", F.left("window", F.col("length")).alias("name")
    )
    rule = F.struct("priority", "name", F.coalesce("value", F.lit("")).alias("order"), "value")
    held = fits.join(names.select("view", "name", "priority", "value"), ["view", "name"]).groupBy("id").agg(
        F.min(rule).alias("r")
    )
    best = pieces.join(numbered.join(held, "id").drop("id"), ["view", "piece"]).groupBy(key).agg(F.min("r").alias("r"))
    return best.select(key, "r.priority", "r.name", "r.value")


def default_rules(spark: SparkSession) -> dict[str, DataFrame]:
    """The lists of :mod:`lexframe.rules` as tables: ``names``, ``scopes`` and ``tools``.

    The tool of an article mention is a pattern, not a name; it ranks between the priorities 0 and 2.
    """
    tools = [(defaults.LAW_KEYWORDS, "law_rag_tool"), (defaults.ROUTER_NAMES, "law_rag_tool"),
             (defaults.NEWS_KEYWORDS, "news_tool"), (defaults.BLOG_KEYWORDS, "blog_tool"),
             (defaults.DB_KEYWORDS, "db_query_tool_async"), (defaults.GENERAL_KEYWORDS, "general_tool")]
    foreign = rule_table(spark, "lowered", [(defaults.FOREIGN_KEYWORDS, "websearch_tool")])
    return {
        "names": rule_table(spark, "dense", [([n], n) for n in defaults.KNOWN_NAMES]),
        "scopes": rule_table(spark, "dense", defaults.SCOPE_RULES),
        "tools": foreign.unionByName(rule_table(spark, "squeezed", tools, first=2)),
    }


def question_views(column: Column) -> dict[str, Column]:
    """The forms of a question in which rules look: without white space, in lower case, and squeezed."""
    return {"dense": collapse_space(column), "lowered": F.lower(column), "squeezed": squeeze(column)}


def detect_by_table(questions: DataFrame, key: str, names: DataFrame | None = None,
                    scopes: DataFrame | None = None, text: str = "question") -> DataFrame:
    """Adds ``name`` and ``scope`` by rule tables; a given table replaces its default list."""
    default = default_rules(questions.sparkSession)
    dense = questions.select(key, collapse_space(F.col(text)).alias("dense"))
    for column, table in [("name", names), ("scope", scopes)]:
        found = match_rules(dense, default[f"{column}s"] if table is None else table, key)
        questions = questions.join(found.select(key, F.col("value").alias(column)), key, "left")
    return questions


def route_by_table(questions: DataFrame, key: str, tools: DataFrame | None = None, text: str = "query",
                   mention_tool: str = "law_rag_tool", mention_priority: int = 1) -> DataFrame:
    """Adds ``rule_tool``: the tool of the first rule, an article mention being the rule of ``mention_priority``."""
    tools = default_rules(questions.sparkSession)["tools"] if tools is None else tools
    views = questions.select(key, *[c.alias(n) for n, c in question_views(F.col(text)).items()])
    found = match_rules(views, tools, key).select(
        key, F.col("priority").alias("__priority"), F.col("value").alias("__tool")
    )
    mention = F.col(text).rlike(ARTICLE_MENTION) & (
        F.col("__priority").isNull() | (F.col("__priority") > mention_priority))
    return questions.join(found, key, "left").withColumn(
        "rule_tool", F.when(mention, mention_tool).otherwise(F.col("__tool"))
    ).drop("__priority", "__tool")
