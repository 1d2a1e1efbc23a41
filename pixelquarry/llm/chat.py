"""Chat formatting by schema fingerprints.

A record is a JSON object in one of several layouts. The set of its nested field paths (array
steps written ``[]``), each with its kinds of values, is hashed; the hash selects a declarative mapping
that says where the turns are, and the record becomes a list of canonical (role, text) turns. Records
with an unknown fingerprint are kept, with null turns, their fingerprint and a reason, so that a mapping can be added.
Kinds are ``object``, ``array`` and ``text`` (any other value, null too: it is read as text).

Template: ``<s>`` then for each turn ``[INST]role[/INST]text</s>``. Control strings inside a role or
text are escaped reversibly: ``\\`` doubles, and the ``<`` or ``[`` that opens a control string becomes
``\\l`` or ``\\b``. Hence no text contains a control string, and the output can be split again.

Defined cases: a record that is null, or no JSON, or no object has null turns and a reason, as has one whose fields hold
other kinds than its layout, or a pair in a history without exactly two items; a null text or role is empty; turns are ordered by turn number (nulls first),
then role, then text, and repeated turns are all kept; a null conversation id is one
conversation; a conversation without turns cannot occur in a turn table, and an empty message
list formats to ``<s>``; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelquarry.session import ship

#: Layouts: the paths with their kinds that must be there, those that may be, and how turns are read.
#: ``each``: an array whose items carry a role and a text; ``parts``: fixed fields in turn order;
#: ``pairs``: an array of [user, assistant] pairs put before the parts. ``roles`` renames roles.
LAYOUTS = (
    {"name": "messages", "need": ["messages:array"], "may": ["messages[]:object", "messages[].role:text", "messages[].content:text"], "each": ("messages", "role", "content")},
    {"name": "conversations", "need": ["conversations:array"], "may": ["conversations[]:object", "conversations[].from:text", "conversations[].value:text"], "each": ("conversations", "from", "value"), "roles": {"human": "user", "gpt": "assistant", "bot": "assistant"}},
    {"name": "prompt", "need": ["prompt:text"], "may": ["completion:text"], "parts": [("user", "prompt"), ("assistant", "completion")]},
    {"name": "question", "need": ["question:text"], "may": ["answer:text"], "parts": [("user", "question"), ("assistant", "answer")]},
    {"name": "system_prompt", "need": ["system:text", "prompt:text", "response:text"], "may": [], "parts": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    {"name": "instruction", "need": ["instruction:text", "output:text"], "may": ["input:text"], "parts": [("user", ("instruction", "input")), ("assistant", "output")]},
    {"name": "history", "need": ["history:array", "instruction:text", "output:text"], "may": ["history[]:array", "history[][]:text"], "pairs": "history", "parts": [("user", "instruction"), ("assistant", "output")]},
)
RENAMED = ("human", "gpt", "bot")


def field_paths(value: object) -> set[str]:
    """Paths and kinds of all values under an object; the array step is ``[]``."""
    out, todo = set(), [("", value)]
    while todo:  # records may be nested deeply
        at, x = todo.pop()
        if isinstance(x, dict):
            todo += [(f"{at}.{k}" if at else k, v) for k, v in x.items()]
        elif isinstance(x, list):
            todo += [(f"{at}[]", v) for v in x]
        if at:
            out.add(f"{at}:{'object' if isinstance(x, dict) else 'array' if isinstance(x, list) else 'text'}")
    return out


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha1("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def known(layouts=LAYOUTS) -> dict[str, dict]:
    """Mapping by fingerprint, for every choice of the fields that may be absent."""
    out = {}
    for layout in layouts:
        for n in range(len(layout["may"]) + 1):
            for some in itertools.combinations(layout["may"], n):
                out[fingerprint({*layout["need"], *some})] = layout
    return out


def read_record(raw: str | None, table: dict[str, dict]) -> tuple[str | None, str | None, list[tuple[str, str]] | None, str | None]:
    """(layout, fingerprint, turns, reason) of one record; turns are null where there is a reason."""
    try:
        record = json.loads(raw) if raw is not None else None
    except (ValueError, RecursionError):
        return None, None, None, "no JSON"
    if not isinstance(record, dict):
        return None, None, None, "no object"
    mark = fingerprint(field_paths(record))
    layout = table.get(mark)
    if layout is None:
        return None, mark, None, "unknown layout"
    if any(len(pair) != 2 for pair in record.get(layout.get("pairs", ""), ())):
        return layout["name"], mark, None, "history of other than pairs"
    turns = [(_clean(role), _clean(text)) for role, text in canonical(record, layout)]
    return layout["name"], mark, turns, None


def _clean(text: str) -> str:
    """Lone surrogates, which JSON can escape and a column cannot hold, become U+FFFD."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _text(x: object) -> str:
    return "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def canonical(record: dict, layout: dict) -> list[tuple[str, str]]:
    """The turns of a record under a layout."""
    turns = []
    if "each" in layout:
        field, role, text = layout["each"]
        for item in record.get(field) or []:
            name = _text(item.get(role))
            turns.append((layout.get("roles", {}).get(name, name), _text(item.get(text))))
    for pair in record.get(layout.get("pairs", ""), None) or []:
        turns += [("user", _text(pair[0])), ("assistant", _text(pair[1]))]
    for role, field in layout.get("parts", []):
        fields = (field,) if isinstance(field, str) else field
        turns.append((role, "\n".join(t for t in (_text(record.get(f)) for f in fields) if t)))
    return turns


def to_turns(records: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """(conv_id, record) to (conv_id, layout, fingerprint, turns array<struct<role, text>>, reason)."""
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known(layouts)
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            read = [read_record(raw, table) for raw in batch.column("record").to_pylist()]
            turns = [t and [{"role": r, "text": x} for r, x in t] for _, _, t, _ in read]
            names, prints, _, reasons = zip(*read, strict=True) if read else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(names, pa.string()), pa.array(prints, pa.string()), pa.array(turns, kind), pa.array(reasons, pa.string())],
                ["conv_id", "layout", "fingerprint", "turns", "reason"],
            )

    return records.select("conv_id", "record").mapInArrow(
        run, "conv_id long, layout string, fingerprint string, turns array<struct<role: string, text: string>>, reason string"
    )


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    opened = F.regexp_replace(doubled, r"<(?=/?s>)", r"\\l")
    return F.regexp_replace(opened, r"\[(?=/?INST\])", r"\\b")


def unescape(text: Column) -> Column:
    return F.array_join(
        F.transform(F.split(text, r"\\\\", -1), lambda x: F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))), "\\"
    )


def render(turned: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss_mask``, the spans (begin, end) of assistant texts in code points."""
    parts = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit("[INST]"), escape(t["role"]), F.lit("[/INST]")).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == "assistant").alias("loss"),
        ),
    )
    start = F.struct(F.lit(3).alias("at"), F.array().cast("array<struct<begin: int, end: int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.struct(begin.alias("begin"), end.alias("end"))
        return F.struct((end + 4).alias("at"), F.when(p["loss"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    pieces = F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit("</s>")))
    return (
        turned.withColumn("_parts", parts)
        .withColumn("formatted", F.concat(F.lit("<s>"), F.array_join(pieces, "")))
        .withColumn("loss_mask", F.aggregate("_parts", start, step, lambda acc: acc["spans"]))
        .drop("_parts")
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation."""
    body = F.substring(formatted, 4, F.length(formatted))
    pieces = F.split(body, "</s>", -1)
    turns = F.slice(pieces, 1, F.size(pieces) - 1)
    return F.transform(
        turns,
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, 7, F.length(p)), "[/INST]", 1)).alias("role"),
            unescape(F.substring(p, F.locate("[/INST]", p) + 7, F.length(p))).alias("text"),
        ),
    )


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped span by span."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, s["begin"] + 1, s["end"] - s["begin"]))), "")


def records_of(conversations: DataFrame) -> DataFrame:
    """A turn table as records of several layouts: a layout is used where it can say the turns exactly.

    By conversation id: message lists, from/value lists, or, for strict user and assistant
    alternation, prompt and completion or an instruction with history.
    """
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content")
    )
    grouped = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    n = F.size("t")
    strict = (n % 2 == 0) & F.forall(F.sequence(F.lit(0), n - 1), lambda i: F.get("t", i)["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"))
    kept_roles = F.forall("t", lambda t: ~t["role"].isin(*RENAMED))
    which = F.coalesce(F.pmod("conv_id", F.lit(3)), F.lit(0))
    messages = F.to_json(F.struct(F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages")))
    from_value = F.to_json(F.struct(F.transform("t", lambda t: F.struct(t["role"].alias("from"), t["content"].alias("value"))).alias("conversations")))
    last_two = [F.get("t", n - 2)["content"], F.get("t", n - 1)["content"]]
    prompt = F.to_json(F.struct(last_two[0].alias("prompt"), last_two[1].alias("completion")))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int") - 2), lambda i: F.array(F.get("t", 2 * i)["content"], F.get("t", 2 * i + 1)["content"]))
    history = F.to_json(F.struct(pairs.alias("history"), last_two[0].alias("instruction"), last_two[1].alias("output")))
    record = (
        F.when((which == 2) & strict & (n == 2), prompt)
        .when((which == 2) & strict & (n > 2), history)
        .when((which == 1) & kept_roles, from_value)
    )
    return grouped.select("conv_id", F.coalesce(record, messages).alias("record"))


def digest(rendered: DataFrame) -> DataFrame:
    """Counts and hashes of each conversation, read back from the formatted text."""
    turns = read_back(F.col("formatted"))
    loss = masked_text(F.col("formatted"), F.col("loss_mask"))
    whole = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (
        rendered.withColumn("_turns", turns)
        .withColumn("_loss", loss)
        .select(
            "conv_id",
            F.size("_turns").cast("long").alias("n_turns"),
            F.sha2(whole, 256).alias("turns_sha256"),
            F.length("_loss").cast("long").alias("loss_chars"),
            F.sha2("_loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """The turn table as formatted conversations with loss masks."""
    return render(to_turns(records_of(conversations)))
