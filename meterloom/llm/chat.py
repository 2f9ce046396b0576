"""Chat formatting with DataFrame operations only.

Conversations come in many layouts. A layout's schema fingerprint (a hash of its nested field paths,
without types and array positions) selects a declarative mapping that says where turns, roles and texts
are; all layouts become conversations (conv_id, conv_key, fingerprint, layout, turns of turn, role and
text), which one template formats. Tables are fingerprinted by their columns, JSON records by the
paths that each has; both look the mapping up in ``LAYOUTS``. Only paths that some layout uses count, so
other fields (names, metadata) don't matter; a layout may lie within up to two objects
(``{"data": {"messages": [...]}}``).

Template, for each turn in order: ``<|role|>``, newline, text, ``</s>``, newline. In roles and
texts, backslashes are doubled and a backslash goes after the first character of each control string
(``<s>``, ``</s>``, ``<|``, ``|>``, ``[INST]``, ``[/INST]``), so the output has control strings only where
turns begin and end, and unescaping (each backslash goes, the character after it stays) gives the
texts back. The loss mask is a list of spans (start, length) of code points of the formatted string: one
for each assistant turn, its escaped text.

A null text or role is read as the empty string; a null turn comes before all others; turns with equal
numbers are ordered by role, then text. In a table with a row for each turn, rows with equal conv_id
(nulls, too) are one conversation; each record is a conversation, whatever its id. conv_key is the id as
text, conv_id the id as a number (null if it is none). A record of no known fingerprint, or one that is
no JSON object, has null layout, turns and formatted text, and a fingerprint of all its paths, or null.
Repeated records all count; an empty table gives no rows; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "</s>\n"
# The control strings.
CONTROL = r"<s>|</s>|<\||\|>|\[INST\]|\[/INST\]"
#: Names of the field that has a conversation's id.
IDS = ("id", "conv_id", "conversation_id")


@dataclass(frozen=True)
class Messages:
    """An array of turn objects; with ``part``, a text is a list of objects whose fields of that name are joined."""

    array: str
    role: str
    text: str
    part: str = ""


@dataclass(frozen=True)
class Fields:
    """A few fields, each the text of a turn: (path, role). Empty fields give no turn; a path may be
    a pair of paths whose texts are joined by a blank line if both have some."""

    turns: tuple[tuple[str | tuple[str, str], str], ...]


@dataclass(frozen=True)
class Rows:
    """A table with a row for each turn."""

    conv: str
    turn: str
    role: str
    text: str


#: Other names of roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}

#: Name and field paths of a layout (each path of its leaves; [] is any element), with its mapping.
LAYOUTS: tuple[tuple[str, tuple[str, ...], Messages | Fields | Rows], ...] = (
    ("turn rows", ("role", "text", "turn"), Rows("conv_id", "turn", "role", "text")),
    ("messages", ("messages[].content", "messages[].role"), Messages("messages", "role", "content")),
    ("message parts", ("messages[].content[].text", "messages[].role"), Messages("messages", "role", "content", "text")),
    ("conversations", ("conversations[].from", "conversations[].value"), Messages("conversations", "from", "value")),
    ("speakers", ("turns[].speaker", "turns[].text"), Messages("turns", "speaker", "text")),
    ("prompt and response", ("prompt", "response"), Fields((("prompt", "user"), ("response", "assistant")))),
    ("prompt and completion", ("completion", "prompt"), Fields((("prompt", "user"), ("completion", "assistant")))),
    ("instruction", ("instruction", "output"), Fields((("instruction", "user"), ("output", "assistant")))),
    ("instruction and input", ("input", "instruction", "output"), Fields(((("instruction", "input"), "user"), ("output", "assistant")))),
    ("instruction and system", ("input", "instruction", "output", "system"), Fields((("system", "system"), (("instruction", "input"), "user"), ("output", "assistant")))),
    ("question and answer", ("answer", "question"), Fields((("question", "user"), ("answer", "assistant")))),
)
USED = sorted({p for _, paths, _ in LAYOUTS for p in paths})
TURNS = "array<struct<turn:long,role:string,text:string>>"
CONVERSATION = ["conv_id", "conv_key", "fingerprint", "layout", "turns"]


def _paths_of_type(t: T.DataType, at: str = "") -> list[str]:
    if isinstance(t, T.StructType):
        return [p for f in t.fields for p in _paths_of_type(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(t, T.ArrayType):
        return _paths_of_type(t.elementType, at + "[]")
    return [at]


def fingerprint_of(paths: Column) -> Column:
    return F.md5(F.array_join(F.array_sort(F.array_distinct(paths)), ","))


def _layout_print(paths: tuple[str, ...]) -> Column:
    return fingerprint_of(F.array(*map(F.lit, paths)))


def leaf_paths(record: Column) -> Column:
    """The paths of a variant's leaves: its schema's text is read from left to right, with a stack of
    the paths of the objects and arrays that are open."""
    token = r"(?:`(?:[^`]|``)*`|[^<>,:` ]+): |OBJECT<|ARRAY<|>|[A-Z_]+(?:\([0-9,]+\))?"
    words = F.regexp_extract_all(F.schema_of_variant(record), F.lit(token), F.lit(0))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("open"), F.lit("").alias("at"), none.alias("found"))

    def step(a: Column, w: Column) -> Column:
        top, name = F.element_at(a["open"], -1), F.regexp_replace(w, "^`|`?: $", "")
        opens, array, field, closes = w.isin("OBJECT<", "ARRAY<"), w == "ARRAY<", w.endswith(": "), w == ">"
        at = F.when(field, F.when(top == "", name).otherwise(F.concat(top, F.lit("."), name))).when(array, F.concat(a["at"], F.lit("[]"))).otherwise(a["at"])
        stack = F.when(opens, F.array_append(a["open"], at)).when(closes, F.slice(a["open"], F.lit(1), F.greatest(F.size(a["open"]) - 1, F.lit(0)))).otherwise(a["open"])
        found = F.when(opens | field | closes, a["found"]).otherwise(F.array_append(a["found"], at))
        return F.struct(stack.alias("open"), at.alias("at"), found.alias("found"))

    return F.aggregate(words, start, step, lambda a: a["found"])


def _first(pattern: str):
    return lambda p: F.regexp_extract(p, pattern, 1)


def _matches(paths: Column) -> Column:
    """The layouts that a record's paths match: (root, fingerprint, number), those of outer objects first."""
    inner = [F.transform(paths, _first(r)) for r in (r"^(\w+)\.", r"^(\w+\.\w+)\.")]
    roots = F.array_distinct(F.concat(F.array(F.lit("")), *inner))
    number = F.create_map(*[x for i, (_, p, _) in enumerate(LAYOUTS) for x in (_layout_print(p), F.lit(i))])
    used = F.array(*map(F.lit, USED))

    def judged(root: Column) -> Column:
        prefix = F.when(root == "", "").otherwise(F.concat(root, F.lit(".")))
        own = F.transform(F.filter(paths, lambda p: p.startswith(prefix)), lambda p: F.substr(p, F.length(prefix) + 1))
        print_ = fingerprint_of(F.array_intersect(own, used))
        return F.struct(root.alias("root"), print_.alias("fingerprint"), F.element_at(number, print_).alias("number"))

    return F.filter(F.transform(roots, judged), lambda x: x["number"].isNotNull())


def canonical_role(role: Column) -> Column:
    out = F.coalesce(role, F.lit(""))
    names = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(F.element_at(names, out), out)


def _str(v: Column, path: str | Column) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def _turns(v: Column, root: Column, how: Messages | Fields | Rows) -> Column:
    """The turns of a record; ``root``: the path of the object that has the layout."""
    at = lambda path: F.concat(root, F.lit(f".{path}"))
    if isinstance(how, Rows):  # a single turn
        return F.array(F.struct(F.try_variant_get(v, at(how.turn), "long").alias("turn"), canonical_role(_str(v, at(how.role))).alias("role"), _str(v, at(how.text)).alias("text"))).cast(TURNS)
    if isinstance(how, Messages):
        items = F.try_variant_get(v, at(how.array), "array<variant>")

        def text(x: Column) -> Column:
            if not how.part:
                return _str(x, f"$.{how.text}")
            parts = F.coalesce(F.try_variant_get(x, f"$.{how.text}", "array<variant>"), F.array().cast("array<variant>"))
            return F.array_join(F.transform(parts, lambda y: _str(y, f"$.{how.part}")), "")

        return F.transform(items, lambda x, i: F.struct(i.cast("long").alias("turn"), canonical_role(_str(x, f"$.{how.role}")).alias("role"), text(x).alias("text"))).cast(TURNS)
    parts = []
    for i, (path, role) in enumerate(how.turns):
        if isinstance(path, tuple):
            a, b = (_str(v, at(p)) for p in path)
            said = F.when((a != "") & (b != ""), F.concat(a, F.lit("\n\n"), b)).otherwise(F.concat(a, b))
        else:
            said = _str(v, at(path))
        parts.append(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), said.alias("text")))
    return F.filter(F.array(*parts), lambda x: x["text"] != "").cast(TURNS)


def conversations_of_records(records: DataFrame, column: str = "record") -> DataFrame:
    """A conversation for each JSON object in a string column, of whatever layout."""
    v = records.select(F.try_parse_json(F.col(f"`{column}`")).alias("v"))
    v = v.withColumn("paths", F.when(F.schema_of_variant("v").startswith("OBJECT"), leaf_paths(F.col("v"))))
    v = v.withColumn("m", F.get(_matches(F.col("paths")), F.lit(0)))
    root = F.when(F.col("m.root") == "", "$").otherwise(F.concat(F.lit("$."), F.col("m.root")))
    turns, name = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for i, (layout, _, how) in enumerate(LAYOUTS):
        mine = F.col("m.number") == i
        turns, name = F.when(mine, _turns(F.col("v"), root, how)).otherwise(turns), F.when(mine, layout).otherwise(name)
    key = F.coalesce(*[F.try_variant_get("v", F.concat(root, F.lit(f".{c}")), "string") for c in IDS], *[F.try_variant_get("v", f"$.{c}", "string") for c in IDS])
    out = v.select(key.alias("conv_key"), F.coalesce(F.col("m.fingerprint"), fingerprint_of(F.col("paths"))).alias("fingerprint"), name.alias("layout"), turns.alias("turns"))
    return out.withColumn("conv_id", F.expr("try_cast(conv_key AS long)")).select(*CONVERSATION)


def conversations_of_rows(df: DataFrame, name: str, paths: tuple[str, ...], how: Rows) -> DataFrame:
    """A conversation for all rows of an id."""
    turn = F.struct(F.col(how.turn).cast("long").alias("turn"), canonical_role(F.col(how.role).cast("string")).alias("role"), F.coalesce(F.col(how.text).cast("string"), F.lit("")).alias("text"))
    key = F.col(how.conv).cast("string") if how.conv in df.columns else F.lit(None).cast("string")
    out = df.groupBy(key.alias("conv_key")).agg(F.sort_array(F.collect_list(turn)).cast(TURNS).alias("turns"))
    return out.select(F.expr("try_cast(conv_key AS long)").alias("conv_id"), "conv_key", _layout_print(paths).alias("fingerprint"), F.lit(name).alias("layout"), "turns")


def canonical(df: DataFrame) -> DataFrame:
    """The conversations of a table. The fingerprint of its columns finds the layout of rows by turn; else
    its rows are records: those in a JSON string column ``record``, or all its columns."""
    have = set(_paths_of_type(df.schema)) & set(USED)
    for name, paths, how in LAYOUTS:
        if have == set(paths) and isinstance(how, Rows):
            return conversations_of_rows(df, name, paths, how)
    if "record" in df.columns:
        return conversations_of_records(df)
    return conversations_of_records(df.select(F.to_json(F.struct("*")).alias("record")))


def fingerprints(conversations: DataFrame) -> DataFrame:
    """(fingerprint, layout, n): how many conversations have each; layout is null where it isn't known."""
    return conversations.groupBy("fingerprint", "layout").agg(F.count("*").alias("n"))


def escaped(s: Column) -> Column:
    doubled = F.regexp_replace(s, r"\\", r"\\\\")
    return F.regexp_replace(doubled, f"(?=(?:{CONTROL}))(.)", r"$1\\")


def unescaped(s: Column) -> Column:
    return F.regexp_replace(s, r"(?s)\\(.)", "$1")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``conversations`` with formatted and loss_spans (start, length; from 0, code points)."""
    head = lambda t: F.concat(F.lit("<|"), escaped(t["role"]), F.lit("|>\n"))
    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))

    def step(a: Column, p: Column) -> Column:
        body, n = a["at"] + F.length(p["head"]), F.length(p["body"]).cast("long")
        spans = F.when(p["loss"], F.array_append(a["spans"], F.struct(body.alias("start"), n.alias("length")))).otherwise(a["spans"])
        return F.struct((body + n + len(END)).alias("at"), spans.alias("spans"))

    rows = conversations.withColumn("parts", parts)
    return rows.select(
        *CONVERSATION[:-1],
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("parts", start, step, lambda a: a["spans"]).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string holds."""
    pieces = F.split(formatted, END)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(
        pieces, lambda p: F.struct(unescaped(F.regexp_extract(p, r"(?s)^<\|(.*?)\|>\n", 1)).alias("role"), unescaped(F.regexp_replace(p, r"(?s)^<\|.*?\|>\n", "")).alias("text"))
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from the output; those of no known layout are left out."""
    out = formatted.where("formatted is not null").withColumns({"t": read_back(F.col("formatted")), "l": loss_text(F.col("formatted"), F.col("loss_spans"))})
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("l").cast("long").alias("loss_chars"),
        F.sha2("l", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def from_records(spark: SparkSession, records: list[str]) -> DataFrame:
    return canonical(spark.createDataFrame([(r,) for r in records], "record string"))
