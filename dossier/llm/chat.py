"""Chat formatting: layouts told apart by a fingerprint of their field paths, one template, reversible escapes."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.shared import map_batches

#: Marks of the template. Inside texts every backslash is doubled and one is put into each control string, of this
#: template or of others in use, so that a text can hold no mark and no tokenizer sees a control string in it.
OPEN, BODY, CLOSE = "<|turn|>", "<|body|>", "<|end|>\n"
_UNSAFE = re.compile(r"\\|<(?=\||/?s>|</?SYS>>|start_of_turn>|end_of_turn>)|\[(?=/?INST\])")
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(re.escape(OPEN) + r"(.*?)" + re.escape(BODY) + r"(.*?)" + re.escape(CLOSE), re.S)


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns. ``paths``: every field path it may have; those in ``needs`` make the layout.

    ``turns``: (role, path) in order for layouts of single fields; or ``items`` with the path of a list and the names of
    its role and text fields. ``join``: paths whose texts follow the text of the path before, after a blank line.
    """

    name: str
    needs: frozenset[str]
    optional: frozenset[str] = frozenset()
    turns: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None
    join: tuple[tuple[str, str], ...] = ()


#: Layouts in public use. The first whose needed paths are there and which knows all others is chosen.
MAPPINGS = (
    Mapping("row", frozenset({"role", "text"}), frozenset({"turn"}), items=("", "role", "text")),
    Mapping("messages", frozenset({"messages[].role", "messages[].content"}), items=("messages", "role", "content")),
    Mapping("from_value", frozenset({"conversations[].from", "conversations[].value"}), frozenset({"system"}), turns=(("system", "system"),), items=("conversations", "from", "value")),
    Mapping("instruction", frozenset({"instruction", "output"}), frozenset({"input", "system"}), turns=(("system", "system"), ("user", "instruction"), ("assistant", "output")), join=(("instruction", "input"),)),
    Mapping("prompt_completion", frozenset({"prompt", "completion"}), frozenset({"system"}), turns=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", frozenset({"prompt", "response"}), frozenset({"system"}), turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question_answer", frozenset({"question", "answer"}), frozenset({"context", "system"}), turns=(("system", "system"), ("user", "question"), ("assistant", "answer")), join=(("question", "context"),)),
    Mapping("preference", frozenset({"prompt", "chosen", "rejected"}), turns=(("user", "prompt"), ("assistant", "chosen"))),
    Mapping("text", frozenset({"text"}), turns=(("assistant", "text"),)),
)
#: Other names of the three roles in list layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def paths_of(value) -> set[str]:
    """Nested field paths of a JSON value; list steps are ``[]``, and fields that are null do not count."""
    out, todo = set(), [(value, "")]
    while todo:
        value, prefix = todo.pop()
        if isinstance(value, dict):
            todo += [(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items()]
        elif isinstance(value, list):
            todo += [(v, prefix + "[]") for v in value]
            if not value:
                out.add(prefix + "[]")
        elif value is not None:
            out.add(prefix)
    return out


def fingerprint(paths: set[str]) -> str:
    """Hash of the sorted field paths: 16 hex digits."""
    return hashlib.blake2b("\n".join(sorted(paths)).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


class Registry:
    """Mapping by fingerprint. Each set of paths is matched against the mappings once and remembered by its hash."""

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS, size: int = 10_000):
        self.mappings, self.size, self.known = mappings, size, {}

    def choose(self, paths: set[str]) -> tuple[str, Mapping | None]:
        key = fingerprint(paths)
        if key not in self.known:
            if len(self.known) >= self.size:
                self.known.clear()
            self.known[key] = next((m for m in self.mappings if m.needs <= paths <= m.needs | m.optional), None)
        return key, self.known[key]


def turns_of(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """Canonical (role, text) turns of a record. Absent fields give no turn; a null text is empty."""
    out = []
    for role, path in mapping.turns:
        if record.get(path) is not None:
            more = [record[extra] for after, extra in mapping.join if after == path and record.get(extra)]
            out.append((role, "\n\n".join(str(x) for x in [record[path], *more])))
    if mapping.items:
        field, role, text = mapping.items
        for item in record.get(field) or [] if field else [record]:
            item = item or {}
            name = "" if item.get(role) is None else str(item[role])
            out.append((ROLES.get(name, name) if field else name, "" if item.get(text) is None else str(item[text])))
    return out


def canonical_turns(records: DataFrame, key: str, record: str = "record", order: str | None = None, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(key, turn, role, text, layout, fingerprint) from JSON records of many layouts.

    ``order``: a column that numbers the records of a key, for layouts that spread a conversation over rows; turns are
    numbered inside a record otherwise. A record that is null, no JSON object or of no known layout gives one row with
    null layout and role, so that nothing is lost silently.
    """
    source = records.select(F.col(key).cast("long").alias("key"), F.col(record).alias("record"), (F.col(order).cast("long") if order else F.lit(None).cast("long")).alias("at"))

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        registry, rows = Registry(mappings), []
        for k, raw, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            try:
                value = json.loads(raw) if raw is not None else None
            except (ValueError, RecursionError):  # no JSON, or nested deeper than it can be read
                value = None
            value = value if isinstance(value, dict) else {}
            name, mapping = registry.choose(paths_of(value))
            turns = turns_of(value, mapping) if mapping else [(None, raw)]
            rows += [{"key": k, "at": at, "turn": n, "role": role, "text": text, "layout": mapping.name if mapping else None, "fingerprint": name} for n, (role, text) in enumerate(turns)]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("key", pa.int64()), ("at", pa.int64()), ("turn", pa.int64()), *((c, pa.string()) for c in ("role", "text", "layout", "fingerprint"))]))

    return map_batches(source, each, "key long, at long, turn long, role string, text string, layout string, fingerprint string")


def escape(text: str) -> str:
    return _UNSAFE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and end of its loss span): the span is the escaped text of an assistant, else empty."""
    head, body = f"{OPEN}{escape(role)}{BODY}", escape(text)
    loss = len(body) if role == "assistant" else 0
    return head + body + CLOSE, len(head), len(head) + loss


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of all turns in a formatted text; raises ValueError if it is not one."""
    at, out = 0, []
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


FORMATTED = "conv_id long, at long, turn long, formatted string, loss_start long, loss_end long"


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, at, turn, formatted, loss_start, loss_end): one row per turn of ``canonical_turns``.

    A conversation's training text is the concatenation of its rows by (at, turn); it stays in rows because one
    conversation may be larger than a task. The loss mask is the span of each row, in code points. Turns without a layout
    keep their raw text under the empty role. Null text is empty.
    """

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = [format_turn(r or "", t or "") for r, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())],
            names=["conv_id", "at", "turn", "formatted", "loss_start", "loss_end"],
        )

    return map_batches(turns.select("key", "at", "turn", "role", "text"), each, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of every conversation, from its formatted rows alone: (conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars).

    Rows are parsed where they are; what each contributes to the digests is then dealt by conversation, sorted, and run
    through two hashes as a stream, so a task holds one batch of a conversation however long it is. Equal (at, turn) are
    taken by the formatted text.
    """

    def parse(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for text, a, b in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
            rows.append((len(read_turns(text)), "".join(f"{r}\n{t}\n" for r, t in read_turns(text)), unescape(text[a:b]), len(text), text))
        n, turns, loss, size, text = zip(*rows, strict=True) if rows else ([],) * 5
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(n, pa.int64()), pa.array(turns, pa.string()), pa.array(loss, pa.string()), pa.array(size, pa.int64())],
            names=["conv_id", "at", "turn", "n", "turns", "loss", "size"],
        )

    parsed = map_batches(formatted.select("conv_id", "at", "turn", "formatted", "loss_start", "loss_end"), parse, "conv_id long, at long, turn long, n long, turns string, loss string, size long")
    dealt = parsed.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_last("at"), "turn", "turns")
    return dealt.mapInArrow(_digest, DIGESTS)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state = None, None
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def row():
        return {"conv_id": now, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}

    for batch in batches:
        rows = []
        for conv, _, _, n, turns, loss, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or conv != now:
                if state is not None:
                    rows.append(row())
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += n
            state[1].update(turns.encode("utf-8", "surrogatepass"))
            state[2] += len(loss)
            state[3].update(loss.encode("utf-8", "surrogatepass"))
            state[4] += size
        yield pa.RecordBatch.from_pylist(rows, schema=schema)
    if state is not None:
        yield pa.RecordBatch.from_pylist([row()], schema=schema)


def whole_conversations(formatted: DataFrame) -> DataFrame:
    """(conv_id, text): each conversation's rows joined, for consumers whose conversations fit in a cell."""
    ordered = F.array_sort(F.collect_list(F.struct("at", "turn", "formatted")))
    return formatted.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["formatted"]), "").alias("text"))
