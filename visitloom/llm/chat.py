"""Chat records of many layouts to canonical turns, and these to training text with a loss mask, in DataFrame functions only.

**Layouts.** Where one table holds records of many layouts (``spark.read.json`` gives such a table: every field of any record is
a column, null where a record lacks it), each row is fingerprinted: the nested paths of the fields it has, such as
``messages[].role``, are joined in order and hashed. The hash selects one of the ``LAYOUTS``, each a declaration of which path
gives which turn; the row's turns come from that mapping. A row whose hash no layout has keeps null turns, so nothing is
guessed and nothing goes. Columns that no layout names are not part of the fingerprint.

**Template.** A turn is its text between the two marks of its role; turns follow each other with nothing between. A text that
holds a control string gets one backslash behind the first sign of it, as do texts that hold it with backslashes there already,
and reading takes one away again: texts come back sign by sign, and a mark in the output is always a mark. The loss mask
is a list of spans, in code points, that cover the texts of assistant turns.

A conversation is one row and one string, as a training example is; it goes to one task, whatever its number of turns. Only
conversations are grouped, so nothing else can become hot.

Defined results: a null text is empty, and so is a null role; a record whose fields are all null has no layout; a field that is
empty is there; rows of one turn number are ordered by role and text, null numbers come last; turns that repeat stay; a null
``conv_id`` is a conversation of its own; texts have any length up to what a string holds (2 GB for the conversation); an
empty table gives no rows; extra columns stay, under their names, and those that clash with the operator's make its own take
an underscore.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitloom.llm.common import fresh_name, named

TURNS = "array<struct<role:string,text:string>>"


# ---- Layouts


@dataclass(frozen=True)
class Layout:
    """``turns``: in order, (role, path) of single fields, of which several of one role in a row are joined by blank lines; or,
    for lists, one pair (path of the role, path of the text). ``optional`` paths may be absent. ``roles`` renames roles."""

    name: str
    turns: tuple[tuple[str, str], ...]
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def paths(self) -> list[str]:
        return [p for pair in self.turns for p in pair if "[]" in p] or [path for _, path in self.turns]

    def fingerprints(self) -> list[str]:
        """Of the paths with every choice of the optional ones."""
        needed = [p for p in self.paths if p not in self.optional]
        return [fingerprint_of([*needed, *some]) for n in range(len(self.optional) + 1)
                for some in itertools.combinations(self.optional, n)]


LAYOUTS = (
    Layout("completion", (("system", "system"), ("user", "prompt"), ("assistant", "completion")), ("system",)),
    Layout("response", (("system", "system"), ("user", "prompt"), ("assistant", "response")), ("system",)),
    Layout("question", (("system", "system"), ("user", "question"), ("assistant", "answer")), ("system",)),
    Layout("instruction", (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")),
           ("system", "input")),
    Layout("messages", (("messages[].role", "messages[].content"),)),
    Layout("from_value", (("conversations[].from", "conversations[].value"),),
           roles=(("human", "user"), ("gpt", "assistant"))),
)


def fingerprint_of(paths: list[str]) -> str:
    return hashlib.md5("|".join(sorted(paths)).encode()).hexdigest()


def _has(schema: T.StructType, path: str) -> bool:
    """Whether the table has the path, as text or as texts in a list of structs."""
    top, _, inner = path.partition("[].")
    fields = {f.name: f.dataType for f in schema.fields}
    if not inner:
        return isinstance(fields.get(top), T.StringType)
    kind = fields.get(top)
    return (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)
            and isinstance({f.name: f.dataType for f in kind.elementType.fields}.get(inner), T.StringType))


def _present(path: str) -> Column:
    top, _, inner = path.partition("[].")
    return F.exists(named(top), lambda x: x[inner].isNotNull()) if inner else named(top).isNotNull()


def fingerprint(schema: T.StructType, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The hash of the paths that a row has, among those that the layouts name."""
    paths = sorted({p for layout in layouts for p in layout.paths if _has(schema, p)})
    return F.md5(F.concat_ws("|", *[F.when(_present(p), F.lit(p)) for p in paths]).cast("binary"))


def _mapped(layout: Layout, schema: T.StructType) -> Column:
    if "[]" in layout.paths[0]:
        (role, text), = layout.turns
        top, role, text = role.partition("[].")[0], role.partition("[].")[2], text.partition("[].")[2]

        def renamed(found: Column) -> Column:
            out = F.coalesce(found, F.lit(""))
            for old, new in layout.roles:
                out = F.when(found == old, F.lit(new)).otherwise(out)
            return out

        return F.transform(F.filter(named(top), lambda x: x.isNotNull()), lambda x: F.struct(
            renamed(x[role]).alias("role"), F.coalesce(x[text], F.lit("")).alias("text")))
    turns = []
    for role, group in itertools.groupby((t for t in layout.turns if _has(schema, t[1])), key=lambda t: t[0]):
        texts = [named(path) for _, path in group]
        turns.append(F.when(F.coalesce(*texts).isNotNull(), F.struct(
            F.lit(role).alias("role"), F.concat_ws("\n\n", *texts).alias("text"))))
    return F.filter(F.array(*turns), lambda x: x.isNotNull())


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with the columns layout (its name) and turns (roles and texts); both are null where no layout matches."""
    names = {n: fresh_name(records, n) for n in ("layout", "turns", "fingerprint_of_row")}
    found = F.col(names["fingerprint_of_row"])
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for each in layouts:
        if all(_has(records.schema, p) for p in each.paths if p not in each.optional):
            match = found.isin(each.fingerprints())
            layout = F.when(match, F.lit(each.name)).otherwise(layout)
            turns = F.when(match, _mapped(each, records.schema).cast(TURNS)).otherwise(turns)
    return records.withColumn(names["fingerprint_of_row"], fingerprint(records.schema, layouts)).withColumns(
        {names["layout"]: layout, names["turns"]: turns}).drop(names["fingerprint_of_row"])


def records_of_turns(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Rows (key, turn, role, text) as one record for each conversation: a question with its answer, an instruction, a list of
    people's turns, or, for all else, a list of messages. Columns: key, prompt, completion, system, instruction, output,
    conversations, messages."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    turns = rows.groupBy(named(key)).agg(F.array_sort(F.collect_list(F.struct(
        F.isnull("turn").alias("unnumbered"), F.col("turn"), role.alias("role"), text.alias("text")))).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    told = roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    talk = ~pair & (roles[0] == "user") & F.forall(roles, lambda r: r.isin("user", "assistant"))
    people = F.transform("t", lambda x: F.struct(
        F.when(x["role"] == "user", F.lit("human")).otherwise(F.lit("gpt")).alias("from"), x["text"].alias("value")))
    messages = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    at = lambda n: F.get("t", F.lit(n))["text"]
    return turns.select(
        named(key), F.when(pair, at(0)).alias("prompt"), F.when(pair, at(1)).alias("completion"),
        F.when(told, at(0)).alias("system"), F.when(told, at(1)).alias("instruction"), F.when(told, at(2)).alias("output"),
        F.when(talk, people).alias("conversations"), F.when(~(pair | told | talk), messages).alias("messages"))


# ---- Template

#: The marks before and after a text, by role; any other role is written out between the first two of ``OTHER``.
MARKS = {"system": ("<<SYS>> ", " <</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")}
OTHER = ("[ROLE] ", " [TEXT] ", " [/TEXT]")
#: Control strings as first sign, backslashes, rest. No control string begins with a sign that one ends with, and none holds
#: another, so they never overlap, with marks either.
_CONTROL = r"([<\[])(\\*){}(/?INST\]|ROLE\]|/?TEXT\]|/?s>|</?SYS>>)"
_TURN = (r"(?s)<<SYS>> .*? <</SYS>>|\[INST\] .*? \[/INST\]|<s> .*? </s>|\[ROLE\] .*? \[TEXT\] .*? \[/TEXT\]")
#: Turns of a very long conversation are taken in groups: a running sum costs the square of its length, and reading a span the
#: length of the string before it.
GROUP = 256


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL.format(""), r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL.format(r"\\"), "$1$2$3")


def _by_role(role: Column, known: dict, other: Column) -> Column:
    out = other
    for name, value in known.items():
        out = F.when(role == name, F.lit(value)).otherwise(out)
    return out


def format_chats(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` with layout, formatted (the training text) and loss_spans: (start, stop) of assistant texts in it, in code
    points, the stop exclusive. Formatted is null where no layout matches, and empty where there are no turns."""
    mapped = canonical_turns(records, layouts)
    layout, turns = mapped.columns[-2:]
    names = {n: fresh_name(mapped, n) for n in ("formatted", "loss_spans")}
    before = lambda t: _by_role(t["role"], {k: v[0] for k, v in MARKS.items()},
                                F.concat(F.lit(OTHER[0]), escaped(t["role"]), F.lit(OTHER[1])))
    after = lambda t: _by_role(t["role"], {k: v[1] for k, v in MARKS.items()}, F.lit(OTHER[2]))
    pieces = F.transform(named(turns), lambda t: F.struct(
        (t["role"] == "assistant").alias("trained"), before(t).alias("open"), escaped(t["text"]).alias("body"),
        after(t).alias("close")))
    made = fresh_name(mapped, "pieces_of_chat")
    whole = F.concat_ws("", F.transform(named(made), lambda p: F.concat(p["open"], p["body"], p["close"])))
    return mapped.withColumn(made, pieces).withColumns({
        names["formatted"]: F.when(named(layout).isNotNull(), whole), names["loss_spans"]: _spans(named(made)),
    }).drop(made, turns)


def _running(sizes: Column) -> Column:
    """0 and the sums of the first 1, 2, ... sizes."""
    return F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda sums, x: F.concat(
        sums, F.array(F.element_at(sums, -1) + x)))


def _groups(items: Column) -> Column:
    """The items in groups of ``GROUP``; no group where there is none."""
    return F.filter(F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size(items) - 1) / GROUP), F.lit(0)).cast("int")),
        lambda g: F.slice(items, g * GROUP + 1, F.lit(GROUP))), lambda g: F.size(g) > 0)


def _spans(pieces: Column) -> Column:
    size = lambda p: (F.char_length(p["open"]) + F.char_length(p["body"]) + F.char_length(p["close"])).cast("long")
    groups = _groups(pieces)
    totals = F.transform(groups, lambda g: F.aggregate(g, F.lit(0).cast("long"), lambda sum_, p: sum_ + size(p)))

    def of_group(group: Column, start: Column) -> Column:
        def span(p: Column, at: Column) -> Column:
            first = start + at + F.char_length(p["open"])
            return F.when(p["trained"], F.struct(first.alias("start"), (first + F.char_length(p["body"])).alias("stop")))

        return F.zip_with(group, _running(F.transform(group, size)), span)

    # The running sums have one number more than there are groups or pieces; its span is null.
    spans = F.flatten(F.filter(F.zip_with(groups, _running(totals), of_group), lambda g: g.isNotNull()))
    return F.coalesce(F.filter(spans, lambda s: s.isNotNull()), F.array().cast("array<struct<start:bigint,stop:bigint>>"))


def read_turns(formatted: Column) -> Column:
    """The turns of a training text: an array of (role, text)."""
    def read(turn: Column) -> Column:
        role, text = F.lit(None).cast("string"), F.lit(None).cast("string")
        named_role = turn.startswith(OTHER[0])
        for name, (first, last) in MARKS.items():
            here = turn.startswith(first)
            role = F.when(here, F.lit(name)).otherwise(role)
            text = F.when(here, F.substr(turn, F.lit(len(first) + 1), F.char_length(turn) - len(first) - len(last))).otherwise(text)
        role = F.when(named_role, F.regexp_extract(turn, r"(?s)^\[ROLE\] (.*?) \[TEXT\] ", 1)).otherwise(role)
        text = F.when(named_role, F.regexp_extract(turn, r"(?s) \[TEXT\] (.*) \[/TEXT\]$", 1)).otherwise(text)
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), read)


def text_under_mask(formatted: Column, spans: Column) -> Column:
    """All text that the spans cover, unescaped span by span, with nothing between."""
    def cut(text: Column, start: Column, stop: Column) -> Column:
        return F.substr(text, (start + 1).cast("int"), (stop - start).cast("int"))

    chunks = F.transform(_groups(spans), lambda g: F.struct(
        g.alias("spans"), g[0]["start"].alias("start"),
        cut(formatted, g[0]["start"], F.element_at(g, -1)["stop"]).alias("text")))
    return F.concat_ws("", F.flatten(F.transform(chunks, lambda c: F.transform(c["spans"], lambda s: unescaped(
        cut(c["text"], s["start"] - c["start"], s["stop"] - c["start"]))))))


def chat_digests(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """Read back from formatted and loss_spans: key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    told = F.concat_ws("", F.transform("turns_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    read = chats.select(named(key), "formatted", read_turns(F.col("formatted")).alias("turns_read"),
                        text_under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return read.select(
        named(key), F.size("turns_read").cast("long").alias("n_turns"), digest(told).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), digest(F.col("loss")).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
