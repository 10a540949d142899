r"""Chat formatting over prefix trees (operator 4).

*Template.* A turn is ``<|im_start|>role\ntext<|im_end|>\n``. In role and text a backslash becomes two, and one is put after the
first character of every occurrence of a control string, so no control string stands inside a turn; a line end in a role
becomes ``\n``. Dropping each single backslash gives the role and text back.

*Tree.* Conversations are dealt by ranges of their path (a hash of each turn, in order), so those that share initial
turns follow one another; conv_id is the last part of the path, so even copies of one conversation spread over parts. One
walk over the sorted conversations keeps the turns of the current path: a conversation leaves it where its turns differ and adds its own
behind, which is depth-first order. A pack is a stretch of that walk of at most `pack_chars` characters and `pack_convs`
conversations (one longer conversation makes a pack of its own); a shared turn stands once in a pack.

*Pack.* text; nodes: start, end (characters of text), parent (node number or -1), position (of its first character on its path;
position ids run on from there), loss (start and end of an assistant's text), ancestors (the stretches of text
that its characters attend to besides their own node up to themselves: the merged intervals of all its ancestors);
leaves: conv_id and its last node (-1: a conversation without turns can't occur, each row is a turn).

Null texts and roles count as empty. Turns come in order of turn, then role and text (nulls first). Rows with a null conv_id form one conversation.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Control strings of public chat templates.
CONTROL = (OPEN, CLOSE, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ASSISTANT = "assistant"
PACK_CHARS, PACK_CONVS = 1 << 17, 1024

NODE = "struct<start:int,end:int,parent:int,position:int,loss_start:int,loss_end:int,ancestors:array<struct<start:int,end:int>>>"
PACK = f"text string, nodes array<{NODE}>, leaves array<struct<conv_id:KEY,node:int>>"

_ESCAPE = re.compile(r"\\|" + f"(?=(?:{'|'.join(map(re.escape, CONTROL))}))(.)", re.S)
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def render(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A turn, and where its text stands in it."""
    head, body = f"{OPEN}{escape_role(role or '')}\n", escape(text or "")
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


def parse(turn: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    head, _, body = turn[len(OPEN) : -len(CLOSE) - 1].partition("\n")
    return unescape_role(head), unescape(body)


def conversations(rows: DataFrame, key: str = "conv_id", parts: int | None = None) -> DataFrame:
    """A row per conversation: key, turns (array of role, text) in order, path."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy(F.col(key).alias("conv_id")).agg(F.array_sort(F.collect_list(turn), _turn_order).alias("turns"))
    path = F.array_join(F.transform("turns", lambda t: F.lpad(F.hex(F.xxhash64(t["role"], t["text"])), 16, "0")), "")
    return convs.withColumn("path", path)


def _turn_order(a, b):
    less = lambda x, y: F.when(x.isNull() & y.isNotNull(), -1).when(x.isNotNull() & y.isNull(), 1).when(x < y, -1).when(x > y, 1)
    return F.coalesce(less(a["turn"], b["turn"]), less(a["role"], b["role"]), less(a["text"], b["text"]), F.lit(0))


class _Pack:
    def __init__(self):
        self.text: list[str] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.path: list[tuple[tuple[str, str], int]] = []  # turns of the current path and their nodes

    def add(self, conv_id, turns: list[tuple[str, str]]) -> None:
        same = 0
        while same < min(len(turns), len(self.path)) and self.path[same][0] == turns[same]:
            same += 1
        del self.path[same:]
        for turn in turns[same:]:
            body, a, b = render(*turn)
            parent = self.path[-1][1] if self.path else -1
            up = self.nodes[parent] if self.path else None
            spans = list(up["ancestors"]) if up else []
            if up:
                if spans and spans[-1]["end"] == up["start"]:
                    spans[-1] = {"start": spans[-1]["start"], "end": up["end"]}
                else:
                    spans.append({"start": up["start"], "end": up["end"]})
            loss = (self.size + a, self.size + b) if turn[0] == ASSISTANT else (0, 0)
            self.nodes.append({"start": self.size, "end": self.size + len(body), "parent": parent, "position": up["position"] + up["end"] - up["start"] if up else 0, "loss_start": loss[0], "loss_end": loss[1], "ancestors": spans})
            self.text.append(body)
            self.size += len(body)
            self.path.append((turn, len(self.nodes) - 1))
        self.leaves.append({"conv_id": conv_id, "node": self.path[-1][1] if self.path else -1})

    def row(self) -> dict:
        return {"text": "".join(self.text), "nodes": self.nodes, "leaves": self.leaves}


def pack(rows: DataFrame, key: str = "conv_id", parts: int | None = None, pack_chars: int = PACK_CHARS, pack_convs: int = PACK_CONVS) -> DataFrame:
    """Packs (text, nodes, leaves) of all conversations in rows of key, turn, role, text."""
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    convs = conversations(rows, key)
    convs = convs.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    schema = _pack_schema(rows.schema[key].dataType.simpleString())

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        own, done = _Pack(), []
        for batch in batches:
            for conv_id, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                turns = [(t["role"], t["text"]) for t in turns]
                if own.leaves and (len(own.leaves) >= pack_convs or own.size + sum(len(r) + len(t) + 32 for r, t in turns) > pack_chars):
                    done.append(own.row())
                    own = _Pack()
                own.add(conv_id, turns)
            if len(done) >= 64:
                yield pa.RecordBatch.from_pylist(done, schema=kind)
                done = []
        if own.leaves:
            done.append(own.row())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=kind)

    return convs.mapInArrow(run, schema)


def _pack_schema(key: str) -> StructType:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(PACK.replace("KEY", key))


def read_packs(packs: DataFrame) -> DataFrame:
    """Per conversation, from its leaf's path: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    from pyspark.sql.types import _parse_datatype_string

    key = packs.schema["leaves"].dataType.elementType["conv_id"].dataType.simpleString()
    schema = _parse_datatype_string(f"conv_id {key}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("text", "nodes", "leaves")}
                out += [dict(zip(schema.names, x)) for x in _read(row["text"], row["nodes"], row["leaves"])]
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return packs.select("text", "nodes", "leaves").mapInArrow(run, schema)


def _read(text: str, nodes: list[dict], leaves: list[dict]):
    known: dict[int, tuple] = {}
    for leaf in leaves:
        if (n := leaf["node"]) not in known:
            chain, at = [], n
            while at >= 0:
                chain.append(nodes[at])
                at = nodes[at]["parent"]
            turns, loss, chars = hashlib.sha256(), [], 0
            for node in reversed(chain):
                assert node["position"] == chars, "positions must run on along a path"
                role, said = parse(text[node["start"] : node["end"]])
                turns.update(f"{role}\n{said}\n".encode())
                loss.append(unescape(text[node["loss_start"] : node["loss_end"]]))
                chars += node["end"] - node["start"]
            lost = "".join(loss)
            known[n] = (len(chain), turns.hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest(), chars)
        yield (leaf["conv_id"], *known[n])
