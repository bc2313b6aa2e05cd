"""State machines as data: rows of (state, event, next, emit), run over the events of each document in order."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY = "*"


class Arc(NamedTuple):
    """What an event does in a state. ANY as a state or event stands for all that have no arc of their own; an emit of
    None gives the next state's name, a next of None stays."""

    state: str
    event: str
    next: str | None
    emit: str | None


#: Zones of a thesis: titles lead to their zone from any other, what stands in a zone has its name; a declaration goes on until
#: one of the titles that end it; keywords and references count only where they may stand.
THESIS = (
    Arc(ANY, "blank", None, "body"),
    Arc(ANY, "originality", "originality", "originality_declaration"),
    Arc(ANY, "abstract_title", "abstract", "abstract_title"),
    Arc(ANY, "en_abstract_title", "en_abstract", "en_abstract_title"),
    Arc(ANY, "toc_title", "toc", "toc_title"),
    Arc(ANY, "acknowledgements_title", "acknowledgements", "acknowledgements_title"),
    Arc(ANY, "appendix_title", "appendix", "appendix_title"),
    Arc("cover", "keywords", "abstract", "keywords"),
    Arc("abstract", "keywords", "abstract", "keywords"),
    Arc("abstract", "en_keywords", "en_abstract", "en_keywords"),
    Arc("en_abstract", "en_keywords", "en_abstract", "en_keywords"),
    Arc("body", "references_title", "references", "references_title"),
    Arc("cover", "heading", "body", "heading"),
    Arc("toc", "heading", "body", "heading"),
    Arc("body", "heading", "body", "heading"),
    Arc("originality", "heading", "body", "heading"),
    *(Arc("originality", e, "originality", "originality_declaration") for e in ("acknowledgements_title", "appendix_title")),
    Arc("originality", ANY, "originality", "originality_declaration"),
)
#: The contents begin with their title and end before the main part.
CONTENTS = (Arc("before", "title", "contents", "begin"), Arc("contents", "main", "after", "end"), Arc("contents", ANY, "contents", "entry"), Arc(ANY, ANY, None, "outside"))


def arcs(table: tuple[Arc, ...], start: str) -> dict[tuple[str, str], tuple[str, str]]:
    """(state, event) to (next, emit) for all states and events of a table; ANY stays as the event of those that it doesn't name.

    An arc of the state and the event counts first, then one of the event in any state, then one of any event in the
    state, then one of any event in any state; without any, the state stays and gives its name.
    """
    states = {start} | {a.state for a in table} | {a.next for a in table if a.next} - {ANY}
    events = {a.event for a in table} | {ANY}
    told = {(a.state, a.event): a for a in reversed(table)}
    found = {}
    for state in states - {ANY}:
        for event in events:
            a = next((told[k] for k in ((state, event), (ANY, event), (state, ANY), (ANY, ANY)) if k in told), Arc(state, event, None, None))
            to = a.next or state
            found[state, event] = to, a.emit or to
    return found


def run(rows: DataFrame, keys: list[str], order: str, event: Column, table: tuple[Arc, ...], start: str) -> DataFrame:
    """(keys, order, event, state, emit) of each row: the state that its event leads to, and what it emits.

    A document's events, in order, are one row while they are folded; null events are events that the table doesn't name.
    Rows that share an order come in the order of their events.
    """
    known = arcs(table, start)
    entries = [x for (s, e), (to, emit) in sorted(known.items()) for x in (F.lit(f"{s}\x00{e}"), F.struct(F.lit(to).alias("state"), F.lit(emit).alias("emit")))]
    table_map = F.create_map(*entries)
    listed = rows.select(*keys, F.struct(F.col(order).alias("at"), F.coalesce(event, F.lit(ANY)).alias("event")).alias("e"))
    each = listed.groupBy(*keys).agg(F.array_sort(F.collect_list("e")).alias("e")).withColumn("__arcs", table_map)

    at = rows.schema[order].dataType.simpleString()
    first = F.struct(F.lit(start).alias("state"), F.array().cast(f"array<struct<at:{at},event:string,state:string,emit:string>>").alias("done"))

    def step(s: Column, e: Column) -> Column:
        look = lambda x: F.try_element_at("__arcs", F.concat(s["state"], F.lit("\x00"), x))
        to = F.coalesce(look(e["event"]), look(F.lit(ANY)))
        done = F.struct(e["at"].alias("at"), e["event"].alias("event"), to["state"].alias("state"), to["emit"].alias("emit"))
        return F.struct(to["state"].alias("state"), F.concat(s["done"], F.array(done)).alias("done"))

    folded = each.select(*keys, F.inline(F.aggregate("e", first, step, lambda s: s["done"])))
    return folded.select(*keys, F.col("at").alias(order), "event", "state", "emit")


def contents_range(rows: DataFrame, keys: list[str], order: str, title: Column, main: Column) -> DataFrame:
    """(keys, begin, end) of the contents: from their title to the row before the main part, or to the last row if none follows."""
    event = F.when(title, "title").when(main, "main")
    found = run(rows, keys, order, event, CONTENTS, "before").filter("state = 'contents'")
    return found.groupBy(*keys).agg(F.min(order).alias("begin"), F.max(order).alias("end"))
