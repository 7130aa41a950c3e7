"""Chat formatting with schema fingerprints.

A record is a JSON object in one of several layouts (messages, prompt and response, instruction and output, ...). The hash
of its sorted nested field paths selects a declarative mapping that says where the turns are. The turns are rendered with
a template whose control strings are escaped inside texts, so that a rendered conversation can be read back exactly.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import lean

#: Template: a turn is HEAD role MIDDLE text TAIL. In roles and texts a backslash goes before each backslash, #, : and <,
#: so no mark can begin inside them.
HEAD, MIDDLE, TAIL = "### ", ": ", " </turn>\n"


def escape(s: str) -> str:
    """Reversible: afterwards every # and < in s has a backslash before it, and every backslash is doubled."""
    return s.replace("\\", "\\\\").replace("#", "\\#").replace("<", "\\<").replace(":", "\\:")


def unescape(s: str) -> str:
    out, i = [], 0
    while (j := s.find("\\", i)) >= 0:
        out += s[i:j], s[j + 1 : j + 2]
        i = j + 2
    return "".join(out) + s[i:]


def render(turns) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text) turns, and the code-point spans under the loss mask: texts of assistant turns."""
    out, spans, n = [], [], 0
    for role, text in turns:
        head, body = HEAD + escape(role) + MIDDLE, escape(text)
        if role == "assistant":
            spans.append((n + len(head), n + len(head) + len(body)))
        out += head, body, TAIL
        n += len(head) + len(body) + len(TAIL)
    return "".join(out), spans


def _find(s: str, what: str, at: int) -> int:
    """The first place of an unescaped mark that begins with a character that is always escaped in texts."""
    while (at := s.find(what, at)) >= 0:
        k = at
        while k and s[k - 1] == "\\":
            k -= 1
        if (at - k) % 2 == 0:
            return at
        at += 1
    raise ValueError("not a formatted conversation")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, i = [], 0
    while i < len(formatted):
        if not formatted.startswith(HEAD, i):
            raise ValueError("not a formatted conversation")
        colon = _find(formatted, ":", i + len(HEAD))
        end = _find(formatted, "<", colon + len(MIDDLE))
        turns.append((unescape(formatted[i + len(HEAD) : colon]), unescape(formatted[colon + len(MIDDLE) : end - 1])))
        i = end - 1 + len(TAIL)
    return turns


def paths(value, prefix: str = "") -> set[str]:
    """Nested field paths of a JSON value with their kinds; items of arrays share the path `[]`."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths(v, f"{prefix}.{k}")} | {prefix + ":object"}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, prefix + "[]")} | {prefix + ":array"}
    return {prefix}


def fingerprint(value) -> str:
    """Hash of the sorted field paths: the same for records of one layout, whatever their values (null counts as a value)."""
    return hashlib.sha256("\n".join(sorted(paths(value))).encode()).hexdigest()[:16]


class Layouts:
    """Mappings by schema fingerprint.

    A mapping is a list of steps: {"role": r, "path": "a.b"} takes one text as a turn of role r, skipping it when absent
    ("optional": True); {"each": "messages", "role": "role", "text": "content", "names": {...}} takes a turn of every item,
    renaming roles; {"own": True, "role": "role", "text": "content"} takes the record itself as a turn. A layout is registered by an example record for each of its shapes. A record of another fingerprint (more
    fields, say) is mapped by the first registered mapping whose required paths it has, those with most of them first; one
    that none fits is kept whole, as a single turn of role `record`.
    """

    def __init__(self):
        self.by_print: dict[str, list[dict]] = {}
        self.mappings: list[list[dict]] = []

    def register(self, steps: list[dict], *examples) -> Layouts:
        for e in examples:
            self.by_print[fingerprint(e)] = steps
        self.mappings = sorted([*self.mappings, steps], key=lambda m: -sum(len(_required(s)) for s in m if not s.get("optional")))
        return self

    def mapping(self, record, seen: dict) -> list[dict] | None:
        """The record's mapping, or None. `seen` keeps what was found for fingerprints that aren't registered."""
        key = fingerprint(record)
        if key in self.by_print:
            return self.by_print[key]
        if key not in seen:
            have = {p.removesuffix(":object").removesuffix(":array") for p in paths(record)}
            fits = (m for m in self.mappings if all(f".{p}" in have for s in m if not s.get("optional") for p in _required(s)))
            if len(seen) > 10_000:
                seen.clear()
            seen[key] = next(fits, None)
        return seen[key]

    def turns(self, record, seen: dict | None = None) -> tuple[list[tuple[str, str]], bool]:
        """Canonical turns, and whether a mapping gave them. Null texts and roles are empty."""
        steps = self.mapping(record, {} if seen is None else seen)
        if steps is None:
            return [("record", _text(record))], False
        out = []
        for s in steps:
            if "own" in s:
                out.append((_text(_at(record, s["role"])), _text(_at(record, s["text"]))))
            elif "each" in s:
                for item in _at(record, s["each"]) or []:
                    role = _text(_at(item, s["role"]))
                    out.append((s.get("names", {}).get(role, role), _text(_at(item, s["text"]))))
            elif not (s.get("optional") and _at(record, s["path"]) is None):
                out.append((s["role"], _text(_at(record, s["path"]))))
        return out, True


def _required(step: dict) -> list[str]:
    if "own" in step:
        return [step["role"], step["text"]]
    return [f"{step['each']}[].{step[k]}" for k in ("role", "text")] if "each" in step else [step["path"]]


def _at(value, path: str):
    for k in path.split("."):
        value = value.get(k) if isinstance(value, dict) else None
    return value


def _text(x) -> str:
    return "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def common_layouts() -> Layouts:
    """The layouts that occur most: messages, ShareGPT-like conversations, prompt and response, instruction and output."""
    m = {"role": "user", "content": "x"}
    c = {"from": "human", "value": "x"}
    names = {"human": "user", "gpt": "assistant", "bot": "assistant"}

    def turn(role, path, **more):
        return {"role": role, "path": path, **more}

    return (
        Layouts()
        .register([{"each": "messages", "role": "role", "text": "content"}], {"messages": [m]}, {"messages": []})
        .register([{"each": "conversations", "role": "from", "text": "value", "names": names}], {"conversations": [c]}, {"conversations": []})
        .register([turn("user", "prompt"), turn("assistant", "response")], {"prompt": "x", "response": "y"})
        .register([turn("user", "prompt"), turn("assistant", "completion")], {"prompt": "x", "completion": "y"})
        .register([turn("system", "system", optional=True), turn("user", "instruction"), turn("user", "input", optional=True), turn("assistant", "output")], {"system": "s", "instruction": "x", "output": "y"}, {"instruction": "x", "output": "y"}, {"instruction": "x", "input": "i", "output": "y"})
        .register([turn("user", "question"), turn("assistant", "answer")], {"question": "x", "answer": "y"})
        .register([{"own": True, "role": "role", "text": "content"}], m, {"role": "user"}, {"content": "x"}, {})
    )


SCHEMA = "conv_id long, layout string, mapped boolean, turns array<struct<role:string,text:string>>, formatted string, loss array<struct<start:int,stop:int>>"


def format_records(records: DataFrame, layouts: Layouts | None = None, id_col: str = "conv_id", json_col: str = "record") -> DataFrame:
    """conv_id, layout (fingerprint), mapped, turns, formatted, loss: one row per record.

    `mapped` tells whether a mapping fits the record; if none does, the record is one turn of role `record`, its JSON as text,
    which has no loss. A malformed record has a null layout and is kept the same way, as it is; a null or empty one has no
    turns. Ids may be null or repeated, as may whole rows; other columns are not returned; an empty table gives no rows. Each
    record is handled on its own, so no row waits for another one's, and has to fit in a task.
    """
    layouts = layouts or common_layouts()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    record = json.loads(text or "")
                except ValueError:
                    layout, turns, mapped = None, ([("record", text)] if text else []), False
                else:
                    layout, (turns, mapped) = fingerprint(record), layouts.turns(record, seen)
                rows.append((i, layout, mapped, turns, *render(turns)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            turns = [[{"role": r, "text": x} for r, x in t] for t in cols[3]]
            loss = [[{"start": a, "stop": z} for a, z in t] for t in cols[5]]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.bool_()), pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), pa.array(cols[4], pa.string()), pa.array(loss, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], ["conv_id", "layout", "mapped", "turns", "formatted", "loss"])

    return records.select(F.col(id_col).cast("long").alias("conv_id"), F.col(json_col).alias("record")).mapInArrow(lean(run), SCHEMA)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, made from `formatted` and `loss` alone: conv_id, n_turns, turns_sha256 (role,
    newline, text, newline of every turn), loss_chars and loss_sha256 (unescaped text under the mask), formatted_chars.
    Rows without a formatted text have null digests."""

    def run(batches):
        for b in batches:
            rows = []
            for i, text, loss in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if text is None:
                    rows.append((i, None, None, None, None, None))
                    continue
                turns = parse(text)
                said = "".join(unescape(text[x["start"] : x["stop"]]) for x in loss)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((i, len(turns), digest, len(said), hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(lean(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def records_of_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, record) of rows (conv_id, turn, role, text): a conversation that is one user and one assistant turn as
    prompt and response, one with a system turn before them as instruction and output, any other as messages.

    Turns come by turn number, then role and text; a null role or text is empty; rows of a null conv_id are one
    conversation; an empty table gives no rows. A conversation is one row, so it has to fit in a task; conversations are
    split among tasks.
    """
    blank = F.lit("")
    item = F.struct(F.col("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("content"))
    g = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("m"))
    roles = F.expr("transform(m, x -> x.role)")
    pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    three = roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    messages = F.to_json(F.struct(F.expr("transform(m, x -> struct(x.role as role, x.content as content))").alias("messages")))
    text = [F.expr(f"get(m, {k}).content") for k in range(3)]
    record = F.when(pair, F.to_json(F.struct(text[0].alias("prompt"), text[1].alias("response")))).when(three, F.to_json(F.struct(text[0].alias("system"), text[1].alias("instruction"), text[2].alias("output")))).otherwise(messages)
    return g.select("conv_id", record.alias("record"))


TURNS = "conv_id long, seq long, layout string, mapped boolean, formatted string, start long, stop long"


def format_turns(turns: DataFrame, layouts: Layouts | None = None) -> DataFrame:
    """conv_id, seq (from 0), layout, mapped, formatted, start, stop of rows (conv_id, turn, role, text), each a record of a
    message's layout: the parts of each conversation's formatted text in order, and where its loss mask covers a part
    (code points from the conversation's beginning; null where it doesn't).

    Turns come by turn number (nulls first), then role and text; a null role or text is empty; rows of a null conv_id are one
    conversation; repeated rows are turns of their own; an empty table gives no rows; further columns are ignored. Rows go to
    tasks by conversation and stream through them in order: a conversation of any length takes the memory of a batch. A
    digest of it has to be taken in order, so one conversation is never dealt to several tasks.
    """
    layouts = layouts or common_layouts()
    record = F.to_json(F.struct("role", F.col("text").alias("content")))
    x = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    order = ["conv_id", "turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    x = x.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", record.alias("record"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        now, seq, at = object(), 0, 0
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i != now:
                    now, seq, at = i, 0, 0
                record = json.loads(text)
                layout, (own, mapped) = fingerprint(record), layouts.turns(record, seen)
                for turn in own:
                    done, loss = render([turn])
                    span = (at + loss[0][0], at + loss[0][1]) if loss else (None, None)
                    rows.append((i, seq, layout, mapped, done, *span))
                    seq, at = seq + 1, at + len(done)
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in TURNS.split(", ")])

    return x.mapInArrow(lean(run), TURNS)


def read_back_turns(parts: DataFrame, in_order: bool = False) -> DataFrame:
    """The digests of read_back() for conversations in parts (conv_id, seq, formatted, start, stop), taken part by part from
    what is formatted and under the mask alone. `in_order`: the parts come from format_turns() as they are."""
    x = parts if in_order else parts.repartition("conv_id").sortWithinPartitions("conv_id", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None  # (conv_id, turns, their digest, masked characters, their digest, characters)

        def told(x):
            return x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]

        def batch(rows):
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            rows = []
            for i, text, start, stop in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or now[0] != i:
                    if now is not None:
                        rows.append(told(now))
                    now = [i, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                if start is not None:
                    said = unescape(text[start - now[5] : stop - now[5]])
                    now[3] += len(said)
                    now[4].update(said.encode("utf-8", "surrogatepass"))
                now[5] += len(text)
            yield batch(rows)
        if now is not None:
            yield batch([told(now)])

    return x.select("conv_id", "formatted", "start", "stop").mapInArrow(lean(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
