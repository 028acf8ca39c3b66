"""What lies one step around an artifact, and the bounded unit around a ticket.

Artifacts: provider, kind, id, title, body, created. Links: src_kind, src, link, target_kind
(artifact, code_symbol), target. All subjects are answered at once; the bounds are the feature
and are ranks that Spark applies before its shuffle, so a ticket with a third of all comments
costs a task no more than its bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import estimate_tokens, truncate_to_tokens
from lodestone.session import materialise, observed
from lodestone.sources.graph import Graph

# Bounds of the parts.
LINKED, SYMBOLS, TESTS, KNOWLEDGE, BUSINESS = 20, 30, 15, 10, 40
# Order of links around a subject, and around a ticket.
NEAR = ("comments_on", "contains_commit", "related_issue", "discusses", "changed_symbol", "references")
TICKET = ("references", "contains_commit", "related_issue", "comments_on", "changed_symbol")
PROVIDERS = ("git", "gitlab", "github", "jira")
LABELS = {"commit": "Commit", "branch": "Branch", "issue": "Issue", "merge_request": "MR", "pull_request": "PR", "comment": "Comment", "review_comment": "Review comment", "code_comment": "Code comment", "docstring": "Docstring", "documentation": "Documentation"}


def rank_of(value: Column, order: tuple[str, ...]) -> Column:
    """Place of a value in an order; values outside it come last."""
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(at > 0, at).otherwise(len(order) + 1).cast("int")


def _top(rows: DataFrame, group: list[str], order: list, count: int, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(name) <= count)


def both_ends(links: DataFrame) -> DataFrame:
    """(here_kind, here, link, there_kind, there) of the links between artifacts, from either end."""
    own = links.filter("target_kind <> 'code_symbol'")
    forth = own.select(F.col("src_kind").alias("here_kind"), F.col("src").alias("here"), "link", F.col("target_kind").alias("there_kind"), F.col("target").alias("there"))
    back = own.select("target_kind", "target", "link", "src_kind", "src")
    return forth.union(back).filter(~((F.col("here") == F.col("there")) & (F.col("here_kind") == F.col("there_kind")))).distinct()


def linked(links: DataFrame, artifacts: DataFrame, bound: int = LINKED) -> DataFrame:
    """(kind, id, rank, link, other_kind, other) of the known artifacts linked to each subject, strongest first."""
    known = artifacts.select(F.col("kind").alias("there_kind"), F.col("id").alias("there"), "provider").distinct()
    near = both_ends(links).join(known, ["there_kind", "there"])
    order = [rank_of(F.col("link"), NEAR), "provider", "there_kind", "there"]
    return _top(near, ["here_kind", "here"], order, bound).select(F.col("here_kind").alias("kind"), F.col("here").alias("id"), "rank", "link", F.col("there_kind").alias("other_kind"), F.col("there").alias("other"))


def symbols_of(links: DataFrame) -> DataFrame:
    """(kind, id, key) of the code symbols that an artifact's own links name."""
    return links.filter("target_kind = 'code_symbol'").select(F.col("src_kind").alias("kind"), F.col("src").alias("id"), F.col("target").alias("key")).distinct()


def changed_names(own: DataFrame, graph: Graph, bound: int = SYMBOLS) -> DataFrame:
    """(kind, id, rank, identifier): the first symbol names of each subject."""
    named = own.join(graph.nodes.select(F.col("stable_key").alias("key"), "identifier"), "key").select("kind", "id", "identifier").distinct()
    return _top(named, ["kind", "id"], ["identifier"], bound)


def knowledge(own: DataFrame, graph: Graph, bound: int = KNOWLEDGE) -> DataFrame:
    """(kind, id, rank, key, identifier) of what the subject's symbols are claimed to implement."""
    claims = graph.edges.filter("status = 'active' and kind in ('implements', 'enforces', 'satisfies')").select(F.col("src").alias("key"), F.col("dst").alias("intent")).distinct()
    nodes = graph.nodes.select(F.col("stable_key").alias("intent"), "identifier")
    found = own.join(claims, "key").select("kind", "id", "intent").distinct().join(nodes, "intent")
    return _top(found, ["kind", "id"], ["identifier", "intent"], bound).select("kind", "id", "rank", F.col("intent").alias("key"), "identifier")


def tests_near(own: DataFrame, related: DataFrame, graph: Graph, bound: int = TESTS) -> DataFrame:
    """(kind, id, rank, identifier) of tests one call from the symbols, or covering related intents."""
    calls = graph.edges.filter("kind = 'calls' and status = 'active'").select("src", "dst")
    around = calls.union(calls.select("dst", "src")).toDF("key", "other").distinct()
    tests = graph.nodes.filter("is_test").select(F.col("stable_key").alias("other"), "identifier")
    called = own.join(around, "key").select("kind", "id", "other").distinct().join(tests, "other").select("kind", "id", "identifier")
    covered = graph.edges.filter("kind = 'covered_by' and status = 'active'").select(F.col("src").alias("key"), F.col("dst").alias("other")).distinct()
    names = graph.nodes.select(F.col("stable_key").alias("other"), "identifier")
    backed = related.select("kind", "id", "key").join(covered, "key").join(names, "other").select("kind", "id", "identifier")
    return _top(called.union(backed).distinct(), ["kind", "id"], ["identifier"], bound)


def ticket_units(anchors: DataFrame, links: DataFrame, artifacts: DataFrame, bound: int = BUSINESS) -> DataFrame:
    """(anchor, place, kind, id, link): what each ticket leads to, breadth first, ``bound`` at most.

    ``anchors``: (anchor) ids of issues. A queue visits neighbours by rank of the link, provider,
    kind and id. Level by level the candidates of a unit are ordered by the place of what led to
    them, which is the queue's order; units that are full take part no more.
    """
    known = artifacts.select("kind", "id", "provider").distinct()
    near = both_ends(links).join(known.select(F.col("kind").alias("here_kind"), F.col("id").alias("here")), ["here_kind", "here"], "left_semi")
    near = near.join(known.select(F.col("kind").alias("there_kind"), F.col("id").alias("there"), "provider"), ["there_kind", "there"])
    near = materialise(near.withColumn("r", rank_of(F.col("link"), TICKET)), "ticket-links")
    found = level = materialise(anchors.select("anchor").distinct().select("anchor", F.lit(0).alias("place"), F.lit("issue").alias("kind"), F.col("anchor").alias("id"), F.lit(None).cast("string").alias("link")), "units-0")
    for n in range(1, bound + 1):
        step = level.select("anchor", F.col("place").alias("led"), F.col("kind").alias("here_kind"), F.col("id").alias("here")).join(near, ["here_kind", "here"])
        step = step.select("anchor", "led", "r", "provider", F.col("there_kind").alias("kind"), F.col("there").alias("id"), "link").join(found.select("anchor", "kind", "id"), ["anchor", "kind", "id"], "left_anti")
        first = step.groupBy("anchor", "kind", "id").agg(F.min(F.struct("led", "r", "provider", "link")).alias("f"))
        full = found.groupBy("anchor").agg(F.max("place").alias("upto")).filter(F.col("upto") < bound)
        order = Window.partitionBy("anchor").orderBy("f.led", "f.r", "f.provider", "kind", "id")
        placed = first.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= bound).join(full, "anchor")
        level = placed.select("anchor", (F.col("upto") + F.col("n")).alias("place"), "kind", "id", F.col("f.link").alias("link")).filter(F.col("place") <= bound)
        level, seen = observed(level, f"units-{n}", rows=F.count(F.lit(1)))
        if not seen["rows"]:
            break
        found = found.unionByName(level)
    return found.filter("place > 0")


def rendered(sections: DataFrame, budget: int) -> DataFrame:
    """(kind, id, text, tokens, truncated) from (kind, id, place, section), cut to a token budget.

    Sections are taken whole in order; the first that does not fit is cut to what is left, and
    nothing follows it. Only as many sections as tokens can ever fit take part.
    """
    if budget <= 0:
        raise ValueError("the budget is empty")
    few = _top(sections.filter("section <> ''"), ["kind", "id"], ["place"], budget + 1, "_n")
    lists = few.groupBy("kind", "id").agg(F.array_sort(F.collect_list(F.struct("_n", "section"))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("taken"), F.lit(False).alias("cut"))

    def step(acc, x):
        room = F.lit(budget).cast("long") - acc["used"]
        cost = estimate_tokens(x["section"])
        short = truncate_to_tokens(x["section"], F.greatest(room - 4, F.lit(0)))
        fits = (short != "") & (estimate_tokens(short) <= room)
        add = lambda text, used, cut: F.struct(used.alias("used"), F.concat(acc["taken"], F.array(text)).alias("taken"), F.lit(cut).alias("cut"))
        stop = F.struct(acc["used"].alias("used"), acc["taken"].alias("taken"), F.lit(True).alias("cut"))
        clipped = F.when(fits, add(short, acc["used"] + estimate_tokens(short), True)).otherwise(stop)
        return F.when(acc["cut"], acc).when(room == 0, stop).when(cost > room, clipped).otherwise(add(x["section"], acc["used"] + cost, False))

    done = lists.select("kind", "id", F.aggregate("all", start, step).alias("f"))
    return done.select("kind", "id", F.array_join("f.taken", "\n\n").alias("text"), F.col("f.used").alias("tokens"), F.col("f.cut").alias("truncated"))


def sections(artifacts: DataFrame, near: DataFrame, names: DataFrame, tests: DataFrame, related: DataFrame) -> DataFrame:
    """(kind, id, place, section): the parts of each subject's text in their order."""
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), F.col("kind")), F.col("kind"))
    shown = artifacts.withColumn("head", F.concat(label, F.lit(":\n"), "id", F.lit(" — "), F.coalesce("title", F.lit("")))).withColumn("body", F.coalesce("body", F.lit("")))
    own = shown.select("kind", "id", F.inline(F.array(F.struct(F.lit(0).alias("place"), F.col("head").alias("section")), F.struct(F.lit(1).alias("place"), F.col("body").alias("section")))))
    other = shown.select(F.col("kind").alias("other_kind"), F.col("id").alias("other"), F.concat_ws("\n", "head", F.when(F.col("body") != "", F.col("body"))).alias("section"))
    around = near.join(other, ["other_kind", "other"]).select("kind", "id", (F.col("rank") + 1).alias("place"), "section")
    listed = lambda rows, column, place, title: rows.groupBy("kind", "id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(column).alias("x")))), lambda s: s["x"]), "\n").alias("x")
    ).select("kind", "id", F.lit(place).alias("place"), F.concat(F.lit(title), "x").alias("section"))
    return own.unionByName(around).unionByName(listed(names, "identifier", 100, "Changed symbols:\n")).unionByName(listed(tests, "identifier", 101, "Tests:\n")).unionByName(listed(related, "identifier", 102, "Already-known related product knowledge:\n"))
