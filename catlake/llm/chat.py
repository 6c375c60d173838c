"""Chat formatting by a declarative template, in DataFrame functions only.

A finite-state machine over roles, given as a table of transitions, checks the order of
turns. Each turn becomes three segments, header, text and footer, of which the text
bears a loss flag for the roles that the template names. Texts can't counterfeit control
strings: a backslash is doubled, and each control string inside a text gets one after
its first character; both can be undone.

Edge cases: a null text is empty; a null role is an empty role, and neither it nor an
unknown role is a valid turn; rows are ordered by turn (null first), then role and text,
so ties and repeated rows have one order and each row is one turn; a null conv_id is a
conversation of its own; a conversation that the machine rejects is formatted all the
same, with valid = false and the first wrong turn's position; empty tables give empty
results; extra columns are ignored. A conversation is one string, so it has to fit one
row (2 GB); only rows of one conversation meet in one place.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick


@dataclass(frozen=True)
class Template:
    """How turns are marked, which texts bear loss, and which role may follow which."""

    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    #: Strings that must not occur inside texts; none may hold another or a backslash.
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "[INST]", "[/INST]", "</s>", "<|endoftext|>")
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state
    machine: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "begin": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    accepts: tuple[str, ...] = ("answered",)

    def __post_init__(self) -> None:
        for a in self.controls:
            if len(a) < 2 or "\\" in a or any(a in b for b in self.controls if b != a):
                raise ValueError(f"control string {a!r} is too short, has a backslash or is part of another")
        if self.after_role != "\n" or not any(self.start == c for c in self.controls):
            raise ValueError("the start mark must be a control string and a role must end with its line")


CHAT = Template()


def escape(text: Column, template: Template = CHAT) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in template.controls:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column, template: Template = CHAT) -> Column:
    out = text
    for c in reversed(template.controls):
        out = F.replace(out, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


#: In roles, which end with their line, one digit after a backslash stands for each of these.
_ROLE = (("\\", "\\0"), ("\n", "\\1"), ("<", "\\2"), ("[", "\\3"))


def _escape_role(role: Column) -> Column:
    for a, b in _ROLE:
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def _unescape_role(role: Column) -> Column:
    for a, b in reversed(_ROLE):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def _run(turns: Column, template: Template) -> Column:
    """The machine over the turns: a struct of its last state (empty once a turn was wrong), the turns read, and the place of the first wrong one."""
    step = F.create_map(
        *[F.lit(x) for state, row in template.machine.items() for role, to in row.items() for x in (f"{state}\x1f{role}", to)]
    )
    after = lambda state, role: F.coalesce(F.try_element_at(step, F.concat(state, F.lit("\x1f"), role)), F.lit(""))

    def read(past: Column, turn: Column) -> Column:
        state = after(past["state"], turn["role"])
        wrong = F.when(past["wrong"].isNull() & (state == ""), past["read"]).otherwise(past["wrong"])
        return F.struct(state.alias("state"), (past["read"] + 1).alias("read"), wrong.alias("wrong"))

    begin = F.struct(F.lit("begin").alias("state"), F.lit(0).cast("long").alias("read"), F.lit(None).cast("long").alias("wrong"))
    return F.aggregate(turns, begin, read)


def format_conversations(rows: DataFrame, template: Template = CHAT) -> DataFrame:
    """(conv_id, n_turns, segments, formatted, turn_marks, loss_spans, valid, wrong_turn) per conversation.

    segments: array of (text, loss); formatted: their texts joined; turn_marks: for each
    turn, where it starts in formatted, and where the part of it that bears loss does and
    ends (null: none), in code points; loss_spans: those parts alone, as (start, end),
    which is what a stored training row needs. Offsets are a running sum over a
    conversation's rows, so the work grows with its turns and not with their square.
    """
    made = pick(rows, "conv_id", "turn", "role", "text").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    made = made.withColumns({
        "head": F.concat(F.lit(template.start), _escape_role(F.col("role")), F.lit(template.after_role)),
        "body": escape(F.col("text"), template),
    })
    size = (F.char_length("head") + F.char_length("body") + len(template.end)).cast("long")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = made.withColumn("size", size).withColumn("at", F.sum("size").over(order) - F.col("size"))
    convs = made.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "role", "head", "body"))).alias("turns"))
    bears = lambda t: t["role"].isin(*template.loss_roles)
    first = lambda t: t["at"] + F.char_length(t["head"])
    marks = F.transform(
        "turns",
        lambda t: F.struct(
            t["at"].alias("at"),
            F.when(bears(t), first(t)).alias("start"),
            F.when(bears(t), first(t) + F.char_length(t["body"])).alias("end"),
        ),
    )
    parts = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(t["head"].alias("text"), F.lit(False).alias("loss")),
                F.struct(t["body"].alias("text"), bears(t).alias("loss")),
                F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    spans = F.transform(F.filter(marks, lambda m: m["start"].isNotNull()), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    return convs.withColumn("run", _run(F.col("turns"), template)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        parts.alias("segments"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(template.end))), "").alias("formatted"),
        marks.alias("turn_marks"),
        spans.alias("loss_spans"),
        F.col("run.state").isin(*template.accepts).alias("valid"),
        F.col("run.wrong").alias("wrong_turn"),
    )


def parse_conversations(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """(conv_id, turns, loss_text, loss_parts, formatted, valid, wrong_turn): turns and loss texts read back from the formatted string.

    The string is cut at the start marks once, and what bears loss is taken from its own
    turn's part, by the turn's marks.
    """
    pieces = F.filter(F.split("formatted", "\\Q" + template.start + "\\E", -1), lambda p, i: i > 0)  # nothing stands before the first mark
    head = lambda p: F.substring_index(p, "\n", 1)
    body = lambda p: F.substring(p, F.char_length(head(p)) + 2, F.char_length(p) - F.char_length(head(p)) - 1 - len(template.end))
    whole = lambda x: F.concat(F.lit(template.start), x["piece"])
    part = lambda x: F.substring(whole(x), (x["mark"]["start"] - x["mark"]["at"] + 1).cast("int"), (x["mark"]["end"] - x["mark"]["start"]).cast("int"))
    marked = F.filter(F.arrays_zip(pieces.alias("piece"), F.col("turn_marks").alias("mark")), lambda x: x["mark"]["start"].isNotNull())
    return (
        formatted.select(
            "conv_id",
            F.transform(pieces, lambda p: F.struct(_unescape_role(head(p)).alias("role"), unescape(body(p), template).alias("text"))).alias("turns"),
            F.transform(marked, lambda x: unescape(part(x), template)).alias("loss_parts"),
            "formatted", "valid", "wrong_turn",
        )
        .withColumn("loss_text", F.array_join("loss_parts", ""))
    )
