"""Chat formatting: typed content parts flattened into marked turns, and the reader of that format."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.llm.common import pick

# Control strings of public chat templates, escaped wherever a text holds them.
CONTROL = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>", "<pad>", "<unk>"]
ESC = "␛"
_CODE = {c: f"{ESC}{i:02d}" for i, c in enumerate([ESC, *CONTROL])}
_TEXT = {v: k for k, v in _CODE.items()}
_FIND = re.compile("|".join(re.escape(c) for c in sorted(_CODE, key=len, reverse=True)))
_READ = re.compile(ESC + r"\d\d")
# The marks of our own template.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"


def escape(text: str) -> str:
    """No control string is left in the result; unescape gives the text back."""
    return _FIND.sub(lambda m: _CODE[m[0]], text)


def unescape(text: str) -> str:
    return _READ.sub(lambda m: _TEXT[m[0]], text)


@dataclass
class Flat:
    """What a visitor has gathered from a turn's parts."""

    text: list[str] = field(default_factory=list)
    refs: list[tuple[str, str, int]] = field(default_factory=list)
    tokens: int = 0


def size(x) -> float:
    """A size of a part: 0 for what is no number, not finite or negative; numbers in texts count; at most 2 ** 31."""
    try:
        x = float(x)
    except (TypeError, ValueError, OverflowError):
        return 0.0
    return min(x, 2.0**31) if x > 0 else 0.0  # not a number is not above 0


class Visitor:
    """Flattens typed parts in order. A part is a dict with `type`, and `text` or `ref` and sizes (see `size`).

    image: one placeholder; tokens = ceil(width / patch) * ceil(height / patch). audio: ceil(seconds * rate).
    document: pages * per_page, pages rounded down. An unknown type, or one that is no text, is kept as an `other`
    placeholder of no tokens. A part that is no dict is a text. Text counts no tokens here: its count depends on the
    tokenizer. Subclasses add types by methods `visit_<type>`.
    """

    def __init__(self, patch: int = 14, rate: float = 25.0, per_page: int = 256):
        self.patch, self.rate, self.per_page = patch, rate, per_page

    def visit(self, parts: list) -> Flat:
        out = Flat()
        for part in parts:
            part = part if isinstance(part, dict) else {"type": "text", "text": "" if part is None else str(part)}
            kind = part.get("type")
            getattr(self, f"visit_{kind}" if isinstance(kind, str) else "", self.visit_other)(part, out)
        return out

    def visit_text(self, part: dict, out: Flat) -> None:
        out.text.append(escape(str(part.get("text") or "")))

    def _place(self, kind: str, part: dict, tokens: int, out: Flat) -> None:
        ref = str(part.get("ref") or "")
        out.text.append(f"<|{kind}:{len(out.refs)}:{tokens}|>")
        out.refs.append((kind, ref, tokens))
        out.tokens += tokens

    def visit_image(self, part: dict, out: Flat) -> None:
        w, h = (math.ceil(size(part.get(k)) / self.patch) for k in ("width", "height"))
        self._place("image", part, w * h, out)

    def visit_audio(self, part: dict, out: Flat) -> None:
        self._place("audio", part, math.ceil(size(part.get("seconds")) * self.rate), out)

    def visit_document(self, part: dict, out: Flat) -> None:
        self._place("document", part, int(size(part.get("pages"))) * self.per_page, out)

    def visit_other(self, part: dict, out: Flat) -> None:
        self._place("other", part, 0, out)


SEGMENT = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("segment", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))), ("expanded_tokens", pa.int64())])


def format_turns(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None, loss_roles: tuple[str, ...] = ("assistant",), visitor: Visitor | None = None) -> DataFrame:
    """One formatted segment for each turn; a conversation is the concatenation of its segments in order of `turn`.

    A turn's formatting depends on that turn alone, so nothing is shuffled and no conversation, however long, is
    gathered. `parts`: a column of JSON arrays of typed parts, used instead of `text` where not null. Columns: conv_id,
    turn, segment, loss_start and loss_end (code points in the segment under the loss mask; null where none),
    attachments, expanded_tokens.

    Null text or role: empty. Null conv_id or turn: kept as null; they sort first. Repeated turns stay, each as a turn.
    Parts that aren't a JSON array are one text part. An empty table gives no rows. Other columns are not read.
    """
    v, cols = visitor or Visitor(), {"conv_id": conv_id, "turn": turn, "role": role, "text": text} | ({"parts": parts} if parts else {})

    def read(text, parts):
        if parts is not None:
            try:
                if isinstance(x := json.loads(parts), list):
                    return x
            except (ValueError, RecursionError):
                pass
            return [parts]
        return [text]

    def run(it):
        for b in it:
            c = b.to_pydict()
            out: dict = {k: [] for k in SEGMENT.names}
            for i in range(b.num_rows):
                flat = v.visit(read(c["text"][i], c["parts"][i] if "parts" in c else None))
                who = c["role"][i] or ""
                head, body = f"{TURN}{escape(who)}{BODY}", "".join(flat.text)
                loss = (len(head), len(head) + len(body)) if who in loss_roles else (None, None)
                for k, x in zip(SEGMENT.names, (c["conv_id"][i], c["turn"][i], head + body + END, *loss, [dict(zip(("kind", "ref", "tokens"), r, strict=True)) for r in flat.refs], flat.tokens), strict=True):
                    out[k].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=SEGMENT)

    df = pick(turns, **cols)
    df = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"), *([F.col("parts").cast("string")] if parts else []))
    return df.mapInArrow(run, "conv_id long, turn long, segment string, loss_start long, loss_end long, attachments array<struct<kind:string,ref:string,tokens:long>>, expanded_tokens long")


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts (placeholders stay as they are) of the turns of a formatted string."""
    out = []
    for seg in formatted.split(TURN)[1:]:
        head, _, body = seg.partition(BODY)
        if not body.endswith(END):
            raise ValueError("a turn isn't closed")
        out.append((unescape(head), unescape(body[: -len(END)])))
    return out


def conversations(segments: DataFrame) -> DataFrame:
    """Whole formatted conversations: conv_id, formatted, attachments, expanded_tokens. A conversation becomes one value, so it has to fit in memory; use the segments where it may not."""
    s = F.array_sort(F.collect_list(F.struct("turn", "segment", "attachments", "expanded_tokens")))
    return segments.groupBy("conv_id").agg(s.alias("s")).select("conv_id", F.array_join("s.segment", "").alias("formatted"), F.flatten("s.attachments").alias("attachments"), F.aggregate("s.expanded_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("expanded_tokens"))
