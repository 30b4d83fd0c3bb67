"""Chat formatting: a role automaton checks turn order; a declarative template gives segments with loss flags."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Strings around a turn, the roles under the loss, and the automaton of turn order.

    A text's or role's "<", any number of "!" and "|" get one more "!", so no control string ("<|...") can occur
    inside; taking one "!" away restores it. A role's backslash and line end become two characters each.
    """

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; the state is named after the last role, "" before the first.
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    #: States in which a conversation may end.
    ends: tuple[str, ...] = ("assistant",)

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, r"<(!*)\|", r"<!$1|")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, r"<!(!*)\|", r"<$1|")

    def escape_role(self, role: Column) -> Column:
        return self.escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))

    def unescape_role(self, role: Column) -> Column:
        parts = F.split(self.unescape(role), r"\\\\")  # at escaped backslashes
        return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")

    def step(self, state: Column, role: Column) -> Column:
        """The automaton's move; null, once reached, stays: the order is broken."""
        out = F.lit(None).cast("string")
        for at, arcs in self.moves.items():
            for got, to in arcs.items():
                out = F.when((state == at) & (role == got), F.lit(to)).otherwise(out)
        return out

    def segments(self, role: Column, text: Column) -> Column:
        """The turn as array<struct<text, loss>>."""
        yes = role.isin(*self.loss_roles)
        part = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
        return F.array(part(F.concat(F.lit(self.open), self.escape_role(role), F.lit(self.after_role)), F.lit(False)), part(self.escape(text), yes), part(F.lit(self.close), F.lit(False)))


def chat_format(conversations: DataFrame, template: ChatTemplate | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid_order, first_bad_turn, formatted, segments.

    Null roles and texts are empty strings; turns are ordered by (turn, role, text), nulls first, so ties and repeated
    rows have a defined place and all are kept. Null conversation ids are one conversation. Other columns are
    ignored. valid_order says whether the automaton accepts the roles; first_bad_turn is the position (from 0) that
    breaks it, n_turns if only the end does. Broken conversations are formatted all the same. An empty table stays empty.

    Built-in functions only. Rows of a conversation are gathered by a partial aggregation, so a task of the shuffle
    reads one row per conversation and map task; texts are cut into segments before that.
    """
    t = template or ChatTemplate()
    r, x = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), r.alias("role"), x.alias("text")).alias("row"))
    got = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("n"), F.lit(-1).alias("bad"))

    def move(acc: Column, row: Column) -> Column:
        to = t.step(acc["state"], row["role"])
        bad = F.when((acc["bad"] < 0) & to.isNull(), acc["n"]).otherwise(acc["bad"])
        return F.struct(to.alias("state"), (acc["n"] + 1).alias("n"), bad.alias("bad"))

    run = F.aggregate("rows", start.cast("struct<state:string,n:int,bad:int>"), lambda a, b: move(a, b).cast("struct<state:string,n:int,bad:int>"))
    done = got.withColumn("run", run).withColumn("segments", F.flatten(F.transform("rows", lambda y: t.segments(y["role"], y["text"]))))
    ok = (F.col("run.bad") < 0) & F.coalesce(F.col("run.state").isin(*t.ends), F.lit(False))
    return done.select(
        "conv_id", F.size("rows").cast("long").alias("n_turns"), ok.alias("valid_order"),
        F.when(~ok, F.when(F.col("run.bad") < 0, F.size("rows")).otherwise(F.col("run.bad"))).alias("first_bad_turn"),
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments",
    )


def chat_read(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The turns of a formatted conversation as array<struct<role, text>>, by its control strings alone."""
    t = template or ChatTemplate()
    pieces = F.split(formatted, r"\Q" + t.open + r"\E")
    turns = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        head = F.substring_index(p, t.after_role, 1)
        body = F.substr(p, F.length(head) + 1 + len(t.after_role), F.length(p) - F.length(head) - len(t.after_role) - len(t.close))
        return F.struct(t.unescape_role(head).alias("role"), t.unescape(body).alias("text"))

    return F.transform(turns, turn)


def loss_text(segments: Column, template: ChatTemplate | None = None) -> Column:
    """All text under the loss mask, unescaped and joined."""
    t = template or ChatTemplate()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: t.unescape(s["text"])), "")
