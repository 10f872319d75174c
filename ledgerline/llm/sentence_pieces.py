"""SentencePiece encoding and decoding by exact backtracking.

A merge-type (BPE) model joins the adjacent pair whose concatenation has the
best score until none is left.  Its result is found here without merging:
from each position the longest vocabulary string is tried first (all matches
of a stretch come from one Aho-Corasick pass), then ever shorter ones, until
one is compatible with the token before it; positions from which nothing
works are marked in a bit field and the token before them is given up.  Two
tokens are compatible when merging their concatenation anew gives the same
two tokens; only the tokens' own merges along the seam matter, which is how
it is tested.  Vocabulary strings that don't merge to themselves are never
used.  The result equals the library's.

Text is cut where no merge can reach: before a run of white-space marks that
follows another character, between a letter and a sign that follows a letter
in no piece, and around characters that no piece holds (they become byte
tokens).  Results of short stretches are cached per worker within
a fixed bound; a stretch may be as long as the text.

Style: Python inside Arrow batches.  Every document is independent, so there
is no shuffle and a lost executor's tasks just run again.

Defined results: null text counts as empty; an empty text gives the end id
alone; repeated rows each get a result; other columns are kept unless their
names clash with added ones, which then replace them.
"""

from __future__ import annotations

import re
from functools import cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCache, map_batches, table, tokenizer_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
INF = float("inf")


class PieceModel:
    """Vocabulary of a merge-type model with byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank, self.id, self.byte_id, self.text, self.byte = {}, {}, {}, {}, {}
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.byte[i] = int(piece[3:5], 16)
            elif lib.is_control(i) or lib.is_unknown(i):
                self.text[i] = ""
            elif lib.is_unused(i):
                raise ValueError("unused pieces aren't supported")
            else:
                self.id[piece], self.rank[piece], self.text[i] = i, -lib.get_score(i), piece.replace(MARK, " ")
        self.end = lib.eos_id()
        chars = {c for p in self.id for c in p}
        if len(self.byte_id) != 256 or not chars <= self.id.keys():
            raise ValueError("byte pieces or single characters are missing")
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece holds a white-space mark after another character")
        # a line end that no piece holds is a border, as is a sign that follows a letter in no piece
        line, also = ("", "") if "\n" in chars else ("\n", "\n|")
        self.line = line
        self.stretches = re.compile(f"{also}{MARK}*[^{MARK}{line}]+|{MARK}+").findall
        joined = {b for p in self.id for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
        after = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalpha() and c not in joined)
        self.word_ends = re.compile(f"(?<=[^\\W\\d_])(?=[{after}])" if after else "(?!)").split
        self.matches = ahocorasick.Automaton()
        for p in self.id:
            self.matches.add_word(p, len(p))
        self.matches.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.edges: dict[str, tuple | None] = {}
        self.shorter: dict[str, str | None] = {}

    def merge(self, word: str) -> list[tuple[int, int, float]]:
        """The merges of ``word`` in order, as (from, to, rank)."""
        parts, at, done = list(word), list(range(len(word))), []
        while len(parts) > 1:
            best, k = min((self.rank.get(parts[k] + parts[k + 1], INF), k) for k in range(len(parts) - 1))
            if best == INF:
                break
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            del at[k + 1]
            done.append((at[k], at[k] + len(parts[k]), best))
        return done

    def edge_history(self, token: str):
        """For a token that merges to itself, its merges in order as (rank,
        symbol then at the right edge) and as (rank, symbol then at the left
        edge); None for a string that doesn't merge to itself."""
        if token not in self.edges:
            done = self.merge(token)
            if len(token) > 1 and (not done or done[-1][:2] != (0, len(token))):
                self.edges[token] = None
            else:
                right, left, last, first = [], [], token[-1], token[0]
                for start, stop, rank in done:
                    last = token[start:] if stop == len(token) else last
                    first = token[:stop] if start == 0 else first
                    right.append((rank, last))
                    left.append((rank, first))
                self.edges[token] = right + [(INF, token)], left + [(INF, token)]
        return self.edges[token]

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging ``a + b`` anew gives ``a`` and ``b``: both tokens'
        merges are replayed in order of rank, and no merge across the seam
        may come first (of equal ranks, the leftmost does)."""
        known = self.pairs.get((a, b))
        if known is None:
            (left, right), i, j = (self.edge_history(a)[0], self.edge_history(b)[1]), 0, 0
            x, y, known = a[-1], b[0], True
            while True:
                next_a, next_b = left[i][0], right[j][0]
                across = self.rank.get(x + y, INF)
                if across < next_a and across <= next_b:
                    known = False
                    break
                if next_a == next_b == INF:
                    break
                if next_a <= next_b:
                    x, i = left[i][1], i + 1
                else:
                    y, j = right[j][1], j + 1
            if len(self.pairs) >= 200_000:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def next_shorter(self, token: str) -> str | None:
        """The longest piece that ``token`` begins with, itself excepted."""
        if token not in self.shorter:
            self.shorter[token] = next((token[:k] for k in range(len(token) - 1, 0, -1) if token[:k] in self.id), None)
        return self.shorter[token]

    def encode_known(self, text: str) -> list[str]:
        """Tokens of a stretch of known characters, by backtracking."""
        n = len(text)
        longest = [0] * n
        for stop, size in self.matches.iter(text):
            longest[stop - size + 1] = size  # later matches from a place are longer
        alive = bytearray(b"\1") * (n + 1)
        tokens: list[str] = []
        pairs, edges, pos = self.pairs, self.edges, 0
        token: str | None = text[:longest[0]]
        while pos < n:
            while token is not None:
                if alive[pos + len(token)] and (edges.get(token) or self.edge_history(token)):
                    if not tokens:
                        break
                    fits = pairs.get((tokens[-1], token))
                    if fits or fits is None and self.compatible(tokens[-1], token):
                        break
                token = self.next_shorter(token)
            if token is None:
                alive[pos] = 0
                token = tokens.pop()
                pos -= len(token)
                token = self.next_shorter(token)
            else:
                tokens.append(token)
                pos += len(token)
                token = text[pos:pos + longest[pos]] if pos < n else None
        return tokens

    def encode_stretch(self, text: str) -> list[int]:
        known = self.id.__contains__
        if all(map(known, text)):
            return [self.id[t] for t in self.encode_known(text)]
        ids: list[int] = []
        start = 0
        for k, c in enumerate(text):
            if not known(c):
                if k > start:
                    ids += [self.id[t] for t in self.encode_known(text[start:k])]
                ids += [self.byte_id[b] for b in c.encode()]
                start = k + 1
        if start < len(text):
            ids += [self.id[t] for t in self.encode_known(text[start:])]
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without an end id."""
        out: list[int] = []
        for part in self.cut(text):
            out += self.encode_stretch(part)
        return out

    def cut(self, text: str) -> list[str]:
        return self.stretches(MARK + text.replace(" ", MARK)) if text else []

    def words(self, text: str) -> list[str]:
        """``text`` as keys of the cache: words with the mark left out, line
        ends with what follows; the cut stretches where blanks aren't single."""
        if not text:
            return []
        if (self.line and text[0] not in " \n" and text[-1] != " " and "  " not in text and " \n" not in text
                and "\n " not in text and MARK not in text and "\0" not in text):
            return text.replace("\n", " \n").split(" ")
        return ["\0" + part for part in self.cut(text)]

    def decode_part(self, ids: list[int]) -> str:
        """Text of ids from inside a sequence: marks as blanks, runs of byte
        ids as UTF-8 (each byte of an invalid run as U+FFFD)."""
        try:
            return "".join([self.text[i] for i in ids])
        except KeyError:
            out, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte:
                run.append(self.byte[i])
                continue
            while run:
                try:
                    out.append(run.decode())
                    run.clear()
                except UnicodeDecodeError as e:
                    out.append(run[:e.start].decode())
                    if e.start < len(run):
                        out.append("\ufffd")
                    del run[:e.start + 1]
            if i is not None:
                out.append(self.text[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of a whole id sequence; the blank that encoding puts first goes."""
        text = self.decode_part(ids)
        first = next((i for i in ids if i in self.byte or self.text[i]), None)
        return text[1:] if first in self.text and text.startswith(" ") else text


@cache
def load(path: str) -> PieceModel:
    return PieceModel(path)


OUTPUTS = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded": pa.string(),
           "decoded_sha256": pa.string()}
SQL_TYPES = {"ids": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded": "string",
             "decoded_sha256": "string"}


#: Pieces of text that a worker remembers, about 0.5 kB each with their parts.
CACHE = 600_000


@cache
def _stretch_cache(path: str, size: int = CACHE) -> WordCache:
    """(number of ids, ids in decimal, decoded text) by a key of ``words``."""
    model = load(path)

    def entry(key: str) -> tuple[int, str, str]:
        part = key[1:] if key[0] == "\0" else key if key[0] == "\n" else MARK + key
        pieces = model.word_ends(part)
        if key[0] == "\n" and len(part) > 1:
            pieces[:1] = ["\n", pieces[0][1:]]
        if len(pieces) > 1:
            made = [stretches["\0" + p] for p in pieces if p]
            return sum(m[0] for m in made), " ".join([m[1] for m in made]), "".join([m[2] for m in made])
        ids = model.encode_stretch(part)
        return len(ids), " ".join(map(str, ids)), model.decode_part(ids)

    stretches = WordCache(entry, size)
    return stretches


def encode(docs: DataFrame, outputs=("ids", "n_tokens"), text: str = "text", end: bool = True,
           path: str | None = None, keep_text: bool = True, cache_size: int = CACHE) -> DataFrame:
    """``docs`` plus any of ``OUTPUTS`` for its texts.  ``decoded`` and its
    digest come from decoding the ids.  ``cache_size`` trades a worker's
    memory for time."""
    path = path or tokenizer_path(MODEL)
    rows = docs.drop(*[c for c in outputs if c != text])
    kept = [f for f in rows.schema.fields if f.name not in outputs and (keep_text or f.name != text)]
    names = [f.name for f in kept]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept),
                        *(f"{o} {SQL_TYPES[o]}" for o in outputs)])

    def run(batches):
        model, stretches = load(path), _stretch_cache(path, cache_size)
        tail = [model.end] if end else []
        for batch in batches:
            made = {o: [] for o in outputs}
            for whole in batch.column(text):
                parts = list(map(stretches.__getitem__, model.words(whole.as_py() or "")))
                ids = " ".join([p[1] for p in parts] + list(map(str, tail)))
                if "ids" in made:
                    made["ids"].append(list(map(int, ids.split())))
                if "n_tokens" in made:
                    made["n_tokens"].append(sum([p[0] for p in parts]) + len(tail))
                if "ids_sha256" in made:
                    made["ids_sha256"].append(sha256(ids.encode()).hexdigest())
                if "decoded" in made or "decoded_sha256" in made:
                    decoded = "".join([p[2] for p in parts])[1:]
                    if "decoded" in made:
                        made["decoded"].append(decoded)
                    if "decoded_sha256" in made:
                        made["decoded_sha256"].append(sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), *(pa.array(made[o], OUTPUTS[o]) for o in outputs)],
                names=[*names, *outputs])

    return map_batches(rows, run, schema)


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"),
                  ("n_tokens", "ids_sha256", "decoded_sha256"), keep_text=False)
