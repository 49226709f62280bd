"""Chat formatting: conversations into one training string with a loss mask, by a declarative template."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    """How a role's turn is written; only texts of roles with ``loss`` are trained on."""

    name: str
    tag: str
    loss: bool = False
    #: Roles that may come right before this one; None stands for the start of the conversation.
    after: tuple[str | None, ...] = ()


@dataclass(frozen=True)
class Template:
    """A turn is ``<s>[TAG] text [/TAG]</s>``; a role without a tag of its own is written out: ``<s>[ROLE] role [/ROLE] text </s>``."""

    roles: tuple[Role, ...]
    start: str = "<s>"
    end: str = "</s>"

    def tags(self) -> list[str]:
        return [r.tag for r in self.roles] + ["ROLE"]


#: The default template and its turn order. A system turn may come first, then user and assistant alternate.
DEFAULT = Template(
    (
        Role("system", "SYS", after=(None,)),
        Role("user", "INST", after=(None, "system", "assistant")),
        Role("assistant", "OUT", loss=True, after=("user",)),
    )
)


def escape(text: Column, t: Template) -> Column:
    r"""Hide control strings: ``\`` becomes ``\\``, the ``<`` or ``[`` that begins one becomes ``\l`` or ``\q``."""
    text = F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"<(?=/?s>)", r"\\l")
    return F.regexp_replace(text, rf"\[(?=/?(?:{'|'.join(t.tags())})\])", r"\\q")


def unescape(text: Column) -> Column:
    """Undo ``escape``: between doubled backslashes, every backslash begins one of the two other marks."""
    mend = lambda x: F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\q"), F.lit("["))
    return F.array_join(F.transform(F.split(text, r"\\\\"), mend), "\\")


def loss_text(segments: Column) -> Column:
    """All text under the loss mask: the segments that have the flag, unescaped, in a row."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def _pieces(turn: Column, t: Template) -> Column:
    """The segments of one turn: (text, loss)."""
    piece = lambda text, loss=False: F.struct(text.alias("text"), F.lit(loss).alias("loss"))
    said = escape(turn["text"], t)
    out = F.array(piece(F.concat(F.lit(f"{t.start}[ROLE] "), escape(turn["role"], t), F.lit(" [/ROLE] "))), piece(said), piece(F.lit(f" {t.end}")))
    for r in t.roles:
        own = F.array(piece(F.lit(f"{t.start}[{r.tag}] ")), piece(said, r.loss), piece(F.lit(f" [/{r.tag}]{t.end}")))
        out = F.when(turn["role"] == r.name, own).otherwise(out)
    return out


def _state(state: Column, role: Column, t: Template) -> Column:
    """Next state of the machine: the role's number from 1, 0 at the start, -1 for good once a turn is out of order."""
    number = {None: 0} | {r.name: k for k, r in enumerate(t.roles, 1)}
    out = F.lit(-1)
    for k, r in enumerate(t.roles, 1):
        out = F.when((role == r.name) & state.isin([number[x] for x in r.after]), F.lit(k)).otherwise(out)
    return out


def format_chats(rows: DataFrame, template: Template = DEFAULT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``segments`` (text, loss), ``formatted`` (their texts in a row), ``valid``,
    ``bad_turn`` (first turn out of order, from 0, else null) and ``n_turns``.

    Rows are ordered by turn (nulls first); ties by role and text, so repeated rows stand side by side. Null roles
    and texts are empty. A null conversation id is a conversation of its own. Turn order never drops anything: a
    conversation that the state machine rejects is formatted all the same and marked not valid. An empty table
    gives no rows; other columns are ignored.
    """
    turns = rows.groupBy(F.col(conv)).agg(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")))).alias("__turns"))
    walk = F.aggregate("__turns", F.struct(F.lit(0).alias("s"), F.lit(0).alias("at")), lambda a, x: F.struct(_state(a["s"], x["role"], template).alias("s"), F.when(_state(a["s"], x["role"], template) < 0, a["at"]).otherwise(a["at"] + 1).alias("at")))
    made = turns.select(conv, "__turns", walk.alias("__walk"), F.flatten(F.transform("__turns", lambda x: _pieces(x, template))).alias("segments"))
    return made.select(
        conv,
        F.size("__turns").cast("long").alias("n_turns"),
        (F.col("__walk")["s"] >= 0).alias("valid"),
        F.when(F.col("__walk")["s"] < 0, F.col("__walk")["at"]).alias("bad_turn"),
        "segments",
        F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"),
    )


def read_back(formatted: Column, t: Template = DEFAULT) -> Column:
    """The turns in a formatted string: (role, text, loss). Texts hold no control strings, so plain splitting finds them."""
    def turn(x: Column) -> Column:
        as_turn = lambda role, text, loss: F.struct(role.alias("role"), text.alias("text"), F.lit(loss).alias("loss"))
        named = f"{t.start}[ROLE] "
        rest = x.substr(F.lit(len(named) + 1), F.length(x))
        cut_at = F.locate(" [/ROLE] ", rest)
        body = rest.substr(cut_at + len(" [/ROLE] "), F.length(rest))
        out = as_turn(unescape(rest.substr(F.lit(1), cut_at - 1)), unescape(body.substr(F.lit(1), F.length(body) - 1)), False)
        for r in t.roles:
            head, tail = f"{t.start}[{r.tag}] ", f" [/{r.tag}]"
            own = as_turn(F.lit(r.name), unescape(x.substr(F.lit(len(head) + 1), F.length(x) - (len(head) + len(tail)))), r.loss)
            out = F.when(x.startswith(head), own).otherwise(out)
        return out

    return F.transform(F.filter(F.split(formatted, t.end), lambda x: x != ""), turn)
