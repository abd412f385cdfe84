"""Chat formatting by schema fingerprints, in DataFrame functions only.

The nested field paths of a record are hashed; the hash selects a declarative mapping to canonical turns
(``conv_id``, ``turn``, ``role``, ``text``). Tables are fingerprinted by their schema, tables of JSON records row by row.
Formatted text marks turns as ``<|im_start|>role``, line feed, text, ``<|im_end|>``, line feed. Inside roles and texts
every ``<``, any number of backslashes, ``|`` gets one more backslash, so that no control string of a text stands in the
output, and taking one away gives the text back. Roles are URL-encoded besides.

Defined cases: NULL texts and roles count as empty; rows of one conversation are put in order by turn (NULL first), then
role and text, and repeated rows are turns of their own; rows without a conversation id form one conversation without id;
rows of tables without an id column are conversations of their own;
columns outside a mapping are not read. An unknown layout raises ``ValueError`` for a table; unknown JSON records come
back from ``unmapped``. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = "struct<turn: bigint, role: string, text: string>"


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns: (role, path of the text) pairs, or a path of messages with role and text fields.

    A path whose text is NULL or empty gives no turn if it is listed in ``optional``.
    """

    name: str
    paths: tuple[str, ...]
    fields: tuple[tuple[str, str], ...] = ()
    messages: str = ""
    role: str = "role"
    text: str = "content"
    roles: dict[str, str] = field(default_factory=dict)
    optional: tuple[str, ...] = ()

    def fingerprint(self) -> str:
        return fingerprint(self.paths)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


MAPPINGS = [
    Mapping("turn rows", ("conv_id", "role", "text", "turn")),
    Mapping("prompt", ("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt and system", ("completion", "prompt", "system"), (("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Mapping("instruction", ("input", "instruction", "output"), (("system", "instruction"), ("user", "input"), ("assistant", "output")), optional=("input",)),
    Mapping("bare instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Mapping("question", ("answer", "question"), (("user", "question"), ("assistant", "answer"))),
    Mapping("messages", ("messages", "messages[]", "messages[].content", "messages[].role"), messages="messages"),
    Mapping(
        "from and value",
        ("conversations", "conversations[]", "conversations[].from", "conversations[].value"),
        messages="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"},
    ),
]
BY_FINGERPRINT = {m.fingerprint(): m for m in MAPPINGS}
#: Columns that name a record and are no part of its layout.
ID_COLUMNS = ("conv_id", "id")


def schema_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """All field paths of a type; ``[]`` stands for the elements of an array."""
    if isinstance(kind, T.StructType):
        dotted = f"{prefix}." if prefix else ""
        return [p for f in kind.fields for p in (dotted + f.name, *schema_paths(f.dataType, dotted + f.name))]
    if isinstance(kind, T.ArrayType):
        return [f"{prefix}[]", *schema_paths(kind.elementType, f"{prefix}[]")]
    return []


def mapping_of(df: DataFrame) -> Mapping:
    """The mapping for a table's layout. Whole rows are tried first, then without id columns, then without what no
    mapping knows at the top level."""
    paths = schema_paths(df.schema)
    known = {p for m in MAPPINGS for p in m.paths}
    tops = [c for c in df.columns if c in known]
    for columns in (df.columns, [c for c in df.columns if c not in ID_COLUMNS], tops, [c for c in tops if c not in ID_COLUMNS]):
        chosen = [p for p in paths if p.split(".")[0].split("[")[0] in columns]
        if (found := BY_FINGERPRINT.get(fingerprint(chosen))) is not None:
            return found
    raise ValueError(f"no mapping for the layout {paths}")


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _record_turns(mapping: Mapping, get) -> Column:
    """The array of turns of one record; ``get`` gives a path's column."""
    if mapping.messages:
        names = F.create_map(*[F.lit(x) for pair in mapping.roles.items() for x in pair]) if mapping.roles else None

        def turn(m: Column, i: Column) -> Column:
            role = _text(m[mapping.role])
            role = F.coalesce(F.element_at(names, role), role) if names is not None else role
            return F.struct(i.cast("long").alias("turn"), role.alias("role"), _text(m[mapping.text]).alias("text"))

        return F.coalesce(F.transform(get(mapping.messages), turn), F.array().cast(f"array<{TURN}>"))
    turns = [
        F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), _text(get(path)).alias("text"))
        for i, (role, path) in enumerate(mapping.fields)
    ]
    present = [
        F.when(_text(get(path)) != "", t) if path in mapping.optional else t for t, (_, path) in zip(turns, mapping.fields)
    ]
    return F.filter(F.array(*present), lambda t: t.isNotNull())


def canonical_turns(df: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` of a table in any known layout."""
    mapping = mapping_of(df)
    if mapping.name == "turn rows":
        return df.select("conv_id", "turn", _text(F.col("role")).alias("role"), _text(F.col("text")).alias("text"))
    conv = next((F.col(c) for c in ID_COLUMNS if c in df.columns), F.monotonically_increasing_id())
    turns = _record_turns(mapping, lambda path: F.col(f"`{path}`")).alias("turns")
    records = df.select(conv.alias("conv_id"), turns)  # rows have their ids before their turns are taken apart
    return records.select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.turn", "t.role", "t.text")


def _json_fingerprint(record: Column) -> Column:
    """The SHA-256 of a JSON record's field paths, as ``schema_paths`` would give them, up to two levels; of
    an array, the paths of all elements together."""
    tops = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))

    def below(top: Column) -> Column:
        value = F.call_function("get_json_object", record, F.concat(F.lit("$."), top))
        first = F.call_function("get_json_object", record, F.concat(F.lit("$."), top, F.lit("[0]")))
        none = F.array().cast("array<string>")
        keys = F.transform(F.from_json(value, "array<string>"), lambda e: F.coalesce(F.json_object_keys(e), none))
        inside = F.transform(F.array_distinct(F.coalesce(F.flatten(keys), none)), lambda k: F.concat(top, F.lit("[]."), k))
        return F.when(first.isNull(), F.array(top)).otherwise(F.concat(F.array(top, F.concat(top, F.lit("[]"))), inside))

    kept = F.filter(tops, lambda t: ~t.isin(*ID_COLUMNS))
    return F.sha2(F.array_join(F.array_sort(F.flatten(F.transform(kept, below))), "\n"), 256)


def canonical_turns_of_json(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """As ``canonical_turns`` for a column of JSON records, each in a layout of its own."""
    record = F.col(json_col)
    marked = df.select(F.col(id_col).alias("conv_id"), record.alias("record"), _json_fingerprint(record).alias("layout"))
    turns = F.lit(None).cast(f"array<{TURN}>")
    for mapping in MAPPINGS:
        if mapping.name == "turn rows":
            continue
        if mapping.messages:
            kind = f"array<struct<{mapping.role}: string, {mapping.text}: string>>"
            get = lambda path, kind=kind: F.from_json(F.get_json_object("record", f"$.{path}"), kind)
        else:
            get = lambda path: F.get_json_object("record", f"$.{path}")
        turns = F.when(F.col("layout") == mapping.fingerprint(), _record_turns(mapping, get)).otherwise(turns)
    return marked.select("conv_id", F.explode(turns).alias("t")).select("conv_id", "t.turn", "t.role", "t.text")


def unmapped(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """The records whose layout no mapping knows, with their fingerprints."""
    known = [m.fingerprint() for m in MAPPINGS if m.name != "turn rows"]
    return df.select(F.col(id_col).alias("conv_id"), _json_fingerprint(F.col(json_col)).alias("layout")).filter(~F.col("layout").isin(known))


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def formatted(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``text`` and ``loss``: the spans (``start``, ``length`` in characters) of the assistant texts."""
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    safe = lambda t: F.struct(F.url_encode(t["role"]).alias("role"), escaped(t["text"]).alias("text"))
    ordered = ordered.select("conv_id", F.transform("turns", safe).alias("turns"))
    open_, close = "<|im_start|>", "<|im_end|>\n"

    def span(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.lit(len(open_) + 1) + F.length(t["role"])
        size = F.length(t["text"])
        here = F.when(t["role"] == "assistant", F.array(F.struct(start.alias("start"), size.alias("length"))))
        return F.struct(
            (start + size + F.lit(len(close))).alias("at"),
            F.concat(acc["spans"], F.coalesce(here, F.array().cast("array<struct<start: int, length: int>>"))).alias("spans"),
        )

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans"))
    written = F.transform("turns", lambda t: F.concat(F.lit(open_), t["role"], F.lit("\n"), t["text"], F.lit(close)))
    return ordered.select(
        "conv_id", F.array_join(written, "").alias("text"), F.aggregate("turns", empty, span)["spans"].alias("loss")
    )


def read_back(chats: DataFrame) -> DataFrame:
    """``conv_id``, ``turns`` (role and text) and ``loss_text`` from formatted text and its loss spans alone."""
    parts = F.split(F.col("text"), r"<\|im_end\|>\n")
    bodies = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.substring(p, len("<|im_start|>") + 1, 2**31 - 1))

    def turn(body: Column) -> Column:
        at = F.instr(body, "\n")
        role = F.url_decode(F.substring(body, F.lit(1), at - 1))
        return F.struct(role.alias("role"), unescaped(F.substring(body, at + 1, F.length(body))).alias("text"))

    lost = F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), s["start"] + 1, s["length"])))
    return chats.select("conv_id", F.transform(bodies, turn).alias("turns"), F.array_join(lost, "").alias("loss_text"), "text")
