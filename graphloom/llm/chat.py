"""Operator 6: chat formatting by token-level assembly.

Every turn's role and text are encoded alone, control strings inside escaped; the ids of turn marks, which
lie beyond the vocabulary so that no text can produce them, are spliced between. A conversation is

    <|turn|> role <|body|> text <|end|>   for each turn

and its loss mask is 1 on the ids of assistants' texts only: +1 where such a segment begins, -1 where it
ends, summed from the left.

Escaping puts a backslash after the first character of each control string, and one more into those that
have some already: `</s>` becomes `<\\/s>`, `<\\/s>` becomes `<\\\\/s>`. Taking one out of each restores
the text. The tokenizer's own special strings are among the control strings.

Conversations may be of any length: turns are encoded before they're brought together, and assembled in a
stream sorted by (conv_id, turn), in parts of at most PART ids, written to the shared folder and read back
part by part. Null text, role: empty. Null conv_id: one conversation of its own. Null turn: first. Ties in
turn: by role, then text; repeated rows are repeated turns. Empty table: only what was added to it.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, small_batches, width

#: Control strings of common templates and of this one (fixed values).
CONTROL = ("<|turn|>", "<|body|>", "<|end|>", "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
MARKS = ("<|turn|>", "<|body|>", "<|end|>")
LOSS_ROLES = ("assistant",)
PART = 1 << 18

_ESCAPE = re.compile("|".join(rf"(?<={re.escape(c[0])})(?=\\*{re.escape(c[1:])})" for c in CONTROL))
_RESTORE = re.compile("|".join(rf"(?<={re.escape(c[0])})\\(?=\\*{re.escape(c[1:])})" for c in CONTROL))


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\", text)


def restore(text: str) -> str:
    return _RESTORE.sub("", text)


class Template:
    """Encoding and decoding with one tokenizer file and the marks' ids behind its vocabulary."""

    def __init__(self, path: str):
        from graphloom.llm.encoder import encoder
        from graphloom.llm.token_counts import byte_chars

        self.enc = encoder(path)
        chars = byte_chars()
        vocab = self.enc.tok.get_vocab(with_added_tokens=True)
        first = max(vocab.values()) + 1
        self.turn, self.body, self.end = range(first, first + 3)
        self.raw = [b""] * first
        for token, i in vocab.items():
            self.raw[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, self.enc.dtype).astype("<u4") for x in self.enc.encode([escape(t) for t in texts])]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join([self.raw[i] for i in ids.tolist()]).decode()


_templates: dict[str, Template] = {}


def template(path: str) -> Template:
    if path not in _templates:
        _templates[path] = Template(path)
    return _templates[path]


SEGMENTS = "conv_id long, turn long, role string, ids binary, loss boolean, order string"
PARTS = "conv_id long, part long, ids binary, mask binary, last boolean"


def assemble(segments: list[tuple[np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the segments one after the other, and the mask by prefix sums of the loss segments' ends."""
    lengths = np.array([len(s) for s, _ in segments], np.int64)
    at = np.concatenate([[0], np.cumsum(lengths)])
    step = np.zeros(at[-1] + 1, np.int8)
    for k, (_, loss) in enumerate(segments):
        if loss:
            step[at[k]] += 1
            step[at[k + 1]] -= 1
    return np.concatenate([s for s, _ in segments]), np.cumsum(step[:-1]).astype(np.uint8)


def format_chats(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, part, ids (4 bytes each), mask (1 byte each), last: the formatted conversations in parts."""

    def encode(batches):
        t = template(tokenizer)
        for batch in batches:
            roles = [r or "" for r in batch.column("role").to_pylist()]
            texts = [x or "" for x in batch.column("text").to_pylist()]
            ids = []
            for r, x in zip(t.encode(roles), t.encode(texts)):
                ids.append(np.concatenate([[t.turn], r, [t.body], x, [t.end]]).astype("<u4").tobytes())
            loss = [r in LOSS_ROLES for r in roles]
            order = [hashlib.md5(x.encode()).hexdigest() for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array(roles, pa.string()), pa.array(ids, pa.binary()), pa.array(loss, pa.bool_()), pa.array(order, pa.string())],
                ["conv_id", "turn", "role", "ids", "loss", "order"],
            )

    def join(batches):
        t = template(tokenizer)
        conv, part, segments, size = None, 0, [], 0

        def flush(last):
            ids, mask = assemble(segments)
            return conv, part, ids.tobytes(), mask.tobytes(), last

        rows = []
        for batch in batches:
            for c, ids, loss in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "ids", "loss"))):
                if segments and (c != conv or size >= PART):
                    rows.append(flush(c != conv))
                    part, segments, size = (0 if c != conv else part + 1), [], 0
                conv = c
                ids = np.frombuffer(ids, "<u4")
                body = int(np.nonzero(ids == t.body)[0][0]) + 1
                segments += [(ids[:body], False), (ids[body:-1], loss), (ids[-1:], False)]
                size += len(ids)
            if rows:
                yield _parts(rows)
                rows = []
        if segments:
            yield _parts([flush(True)])

    small_batches(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    turns = rows.mapInArrow(encode, SEGMENTS).repartition(width(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "order")
    return turns.mapInArrow(join, PARTS)


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["conv_id", "part", "ids", "mask", "last"])


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_chats(parts: DataFrame, tokenizer: str) -> DataFrame:
    """What the formatted parts say, digested: turns and loss text decoded from the ids and the mask alone."""

    def run(batches):
        t = template(tokenizer)
        state = None
        for batch in batches:
            out = []
            for conv, _, raw, mask, last in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None:
                    state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids, mask = np.frombuffer(raw, "<u4"), np.frombuffer(mask, np.uint8)
                at = [np.nonzero(ids == m)[0].tolist() for m in (t.turn, t.body, t.end)]
                for a, b, e in zip(*at):
                    role, text = t.decode(ids[a + 1 : b]), t.decode(ids[b + 1 : e])
                    state[0] += 1
                    state[1].update(f"{restore(role)}\n{restore(text)}\n".encode())
                    state[4] += sum(map(len, MARKS)) + len(role) + len(text)
                edges = np.diff(np.concatenate([[0], mask, [0]]).astype(np.int8))
                for a, e in zip(np.nonzero(edges == 1)[0].tolist(), np.nonzero(edges == -1)[0].tolist()):
                    text = restore(t.decode(ids[a:e]))
                    state[2] += len(text)
                    state[3].update(text.encode())
                if last:
                    out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    state = None
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    n = width(parts.sparkSession)
    return parts.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, DIGESTS)


def chat_digests(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """Format, write to the shared folder, read back and digest."""
    return read_chats(materialize(format_chats(conversations, tokenizer), "chats"), tokenizer)
