"""SentencePiece encoding and decoding for byte-fallback merge models.

A sequence of pieces is the merge result of its text exactly when every piece
merges from its own characters and every two neighbours, merged again from the
characters of both, come out as the same two pieces: the first merge across a
border would already happen between those two. So the encoder walks the text
left to right, takes the longest piece that an Aho-Corasick automaton finds at
a position, keeps it if it is compatible with its left neighbour, tries shorter
ones, and steps back where none fits; a bitfield marks positions that have
failed, so none is tried twice. Characters outside the model become bytes.

No piece has a word mark after another character, so words never merge with
each other, and ids of words are kept in a bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices
from .tokens import Kept, distinct, gather

MARK = "▁"
CUTS = ".,;:!?*&%$#|()\n"
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
CODES = "doc_id long, n_tokens long, ids binary, decoded string"


class PieceEncoder:
    def __init__(self, path: str, limit: int = 400_000):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        kinds = pb.ModelProto.SentencePiece
        plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or not plain or not model.trainer_spec.byte_fallback:
            raise ValueError("only merge models with byte fallback and no normalisation are supported")
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.id) or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("pieces across words, user-defined or unused pieces are not supported")
        self.code = {p: i.to_bytes(4, "little") for p, i in self.id.items()}
        pairs = {pair for p in self.id for pair in zip(p, p[1:])}
        apart = "".join(c for c in CUTS if not any((c == a) != (c == b) and c in (a, b) and not (a in CUTS and b in CUTS) for a, b in pairs))
        self.cuts = re.compile(f"[^{re.escape(apart)}]+|[{re.escape(apart)}]+" if apart else "(?s).+", re.S)
        self.byte = {int(p.piece[3:5], 16): i.to_bytes(4, "little") for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.limit = limit
        self.compatible: dict[tuple[str, str], bool] = {}
        self.units = Kept(limit)  # words, without the one mark before them
        self.parts = Kept(limit)

    def merge(self, text: str) -> list[str]:
        """Merges from single characters: best score first, then leftmost."""
        parts, nxt, prv = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        score, n = self.score, len(text)
        heap = [(-score[p], i, p) for i in range(n - 1) if (p := parts[i] + parts[i + 1]) in score]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = nxt[i]
            if not parts[i] or j >= n or parts[i] + parts[j] != p:
                continue
            parts[i], parts[j] = p, ""
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (q := p + parts[nxt[i]]) in score:
                    heapq.heappush(heap, (-score[q], i, q))
            if prv[i] >= 0 and (q := parts[prv[i]] + p) in score:
                heapq.heappush(heap, (-score[q], prv[i], q))
        return [p for p in parts if p]

    def fits(self, left: str, right: str) -> bool:
        """Whether two neighbours stay as they are when merged again; an empty left asks for the piece alone."""
        key = (left, right)
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > self.limit:
                self.compatible.clear()
            known = self.compatible[key] = self.merge(left + right) == ([left, right] if left else [right])
        return known

    def pieces(self, text: str) -> list[str]:
        """The pieces of one word; a character that the model lacks stands for itself."""
        n, out, at, left = len(text), [], 0, ""
        failed = bytearray(n // 8 + 1)  # a bit for each position
        found: list[list[str]] = [[] for _ in text]
        for end, p in self.automaton.iter(text):
            found[end - len(p) + 1].append(p)  # shorter ones come first
        known = self.compatible
        while at < n:
            options = found[at]
            if not options:
                out.append(text[at])
                at, left = at + 1, ""
                continue
            for p in reversed(options):
                end = at + len(p)
                if failed[end >> 3] >> (end & 7) & 1:
                    continue
                fit = known.get((left, p))
                if fit is None:
                    fit = self.fits(left, p)
                if fit:
                    out.append(p)
                    at, left = at + len(p), p
                    break
            else:  # nothing fits here behind this neighbour: mark the position, step back
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise ValueError(f"no piece sequence for {text!r}")
                at -= len(out.pop())
                left = out[-1] if out and out[-1] in self.id else ""
        return out

    def unit(self, text: str) -> bytes:
        """Ids of a word, cut where no piece holds the characters on both sides."""
        out, parts = self.cuts.findall(text), self.parts
        for p in parts.missing(list(dict.fromkeys(out))):
            parts.young[p] = b"".join([self.code[x] if x in self.code else b"".join([self.byte[b] for b in x.encode()]) for x in self.pieces(p)])
        return b"".join([parts.young[p] for p in out])

    def learn(self, units: list[str]) -> list[bytes]:
        """Ids of different words, each without the one mark before it."""
        for u in self.units.missing(units):
            self.units.young[u] = self.unit(u if u[:1] == MARK else MARK + u)
        return [self.units.young[u] for u in units]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids with begin and end of each text; null is the empty text."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, f"  |{MARK}|^ | $|^$")
        codes, bounds, units = distinct(pc.split_pattern(texts.filter(pc.invert(odd)), " "))
        ids, bounds = gather(codes, bounds, self.learn(units))
        found, out = iter(zip(bounds[:-1].tolist(), bounds[1:].tolist())), []
        begin, end = (np.array([i], "<u4") for i in (self.library.bos_id(), self.library.eos_id()))
        for i, is_odd in enumerate(odd.to_pylist()):
            if is_odd:
                text = texts[i].as_py().replace(" ", MARK)
                body = np.frombuffer(b"".join([self.unit(u) for u in _UNIT.findall(MARK + text)]) if text else b"", "<u4")
            else:
                a, b = next(found)
                body = ids[a:b]
            out.append(np.concatenate([begin, body, end]))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded.

    With ``digests`` the last two are replaced by their SHA-256, so that whole
    texts need not leave the workers. A null or empty text has the begin and
    end ids alone; a null id stays null; repeated rows are encoded each; an
    empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        enc = encoder(model)
        for batch in slices(batches, 1):
            ids = enc.encode(batch.column(1))
            n = pa.array([len(x) for x in ids], pa.int64())
            if digests:
                cols = [pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(enc.decode(x).encode()).hexdigest() for x in ids], pa.string())]
                names = ["ids_sha256", "decoded_sha256"]
            else:
                cols, names = [pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([enc.decode(x) for x in ids], pa.string())], ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(0), n, *cols], names=["doc_id", "n_tokens", *names])

    bounded(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else CODES
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
