"""Token counts with a whole-token shortcut, for SentencePiece BPE models with byte fallback.

Once, on the driver, it is proved which vocabulary strings encode alone as exactly one token. Executors cut texts at
places that no merge can cross (before a run of spaces, and around characters such as the line feed that no piece
holds), look each part up among the proved strings and a bounded memory of earlier parts, and let the library merge only
the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_of

SPACE = "▁"


class Cutter:
    """The exact token counter of one model; the shortcut holds only under what ``__init__`` checks."""

    def __init__(self, model: bytes, proved: dict[str, int] | None = None, limit: int = 800_000):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))]
        #: No piece holds a space after another character, none a line feed, a line feed is one byte token, a text gets a space in front, and spaces stay.
        self.cuts = (
            not any(re.search(f"[^{SPACE}]{SPACE}", x) or "\n" in x for x in pieces)
            and self.sp.encode("\n", out_type=str) == [SPACE, "<0x0A>"]
            and self.sp.encode(" a  a ", out_type=str)[-1] == SPACE
        )
        self.parts = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+").findall
        self.feed = self.sp.piece_to_id("<0x0A>")
        known = dict(proved) if proved is not None else {x: 1 for x in pieces if self.cuts and self.tokens([x]) == [1]}
        #: Parts without and with one space in front, the space left out.
        self.bare = {x: 1 for x in known if x[0] != SPACE}
        self.spaced = {x[1:]: 1 for x in known if x[0] == SPACE and x[1:2] != SPACE}
        self.known, self.limit = known, len(known) + limit

    def tokens(self, parts: list[str]) -> list[int]:
        """Tokens of each part, merged by the library in one call: no merge crosses the line feeds between them."""
        ids = self.sp.encode("\n" + "\n".join(parts).replace(SPACE, " ")) + [self.feed]
        at = [i for i, x in enumerate(ids) if x == self.feed]
        return [b - a - 1 for a, b in zip(at, at[1:], strict=False)]

    def looked_up(self, known: dict[str, int], parts: list[str], front: str) -> int:
        counts = list(map(known.get, parts))
        if None in counts:
            rest = [x for x, n in zip(parts, counts, strict=True) if n is None]
            found = self.tokens([front + x for x in rest])
            if len(self.bare) + len(self.spaced) < self.limit:
                known.update((x, n) for x, n in zip(rest, found, strict=True) if len(x) < 200)
            return sum(n for n in counts if n is not None) + sum(found)
        return sum(counts)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.cuts:
            return len(self.sp.encode(text))
        lines = text.split("\n")
        bare, spaced, rare, total = [], [], [], len(lines) - 1
        for i, line in enumerate(lines):
            parts = line.split(" ")
            if SPACE in line or "" in parts:  # runs of spaces, or no word at all
                line = SPACE * (not i) + line.replace(" ", SPACE)
                if line:
                    rare += self.parts(line)
            else:
                if i:
                    bare.append(parts[0])
                    del parts[0]
                spaced += parts
        return total + self.looked_up(self.bare, bare, "") + self.looked_up(self.spaced, spaced, SPACE) + (sum(self.tokens(rare)) if rare else 0)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of every row's whole text.

    ``model_path`` is a SentencePiece model; the driver reads it and ships its bytes (half a MB for 32,000 pieces). No
    begin, end or added tokens; special strings in a text are ordinary text. Null and empty texts have 0 tokens. Rows
    stay as they are: repeated rows give repeated rows, other columns are ignored, an empty table gives no rows.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    proved = docs.sparkSession.sparkContext.broadcast(Cutter(model).known)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    held: dict = {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held["cutter"] = Cutter(shipped.value, proved.value)
        counts = held["cutter"].count
        for batch in batches:
            tokens = pa.array([counts(x or "") for x in batch.column(2).to_pylist()], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), tokens], ["doc_id", "n_bytes", "n_tokens"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return text.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
