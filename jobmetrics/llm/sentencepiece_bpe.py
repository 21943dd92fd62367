"""Byte-pair encoding and decoding of SentencePiece models with a table of last tokens per prefix.

A sequence of tokens is the encoding of its text exactly if every two neighbours are the encoding of their own
concatenation. So each prefix of a text has one last token: of the tokens that end there (found by an automaton over
all pieces) the one that is compatible with the last token of the prefix before it. The ids are read off backwards.

No piece of a model of this kind continues past a word into the next space mark, nor from a word into most punctuation,
so a text falls into words that are encoded one by one and remembered; a model with such pieces is encoded whole.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections import Counter
from collections.abc import Iterable
from hashlib import sha256

import ahocorasick
from pyspark.sql import DataFrame

from jobmetrics.llm.batches import documents_of, map_texts, remembered

MARK = "▁"
#: Words that a worker remembers at a time, and the longest word that it does.
REMEMBERED, REMEMBERED_LENGTH = 1 << 17, 40
NONE = -1
BYTE_MARK = 0xDC00
BYTES = re.compile("[\udc00-\udcff]+")


class BpeModel:
    """The pieces of a BPE model with byte fallback and identity normalisation, and the tables to encode with."""

    def __init__(self, model_file: str):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = processor.get_piece_size()
        self.begin, self.end, self.unknown = processor.bos_id(), processor.eos_id(), processor.unk_id()
        self.pieces = [processor.id_to_piece(i) for i in range(n)]
        self.byte_ids = [processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        silent = {self.begin, self.end, self.unknown, *self.byte_ids}
        self.normal = {p: i for i, p in enumerate(self.pieces) if i not in silent and not processor.is_control(i) and not processor.is_unused(i)}
        self.score = [processor.get_score(i) for i in range(n)]
        self.silent = {i for i in range(n) if processor.is_control(i)}
        #: What each id adds to a text; byte pieces as lone surrogates, which no text holds.
        self.shown = ["" if i in self.silent else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        self.shown[self.unknown] = " ⁇ "
        for b, i in enumerate(self.byte_ids):
            self.shown[i] = chr(BYTE_MARK + b)
        self.width = [len(p) for p in self.pieces]
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.normal)
        self.automaton = ahocorasick.Automaton()
        self._pairs: dict[tuple[int, int], bool] = {}
        self._words = _Words(self)
        self._learn_joins()
        self._word = self._word_pattern()

    def _word_pattern(self) -> re.Pattern:
        """Cuts a text only between characters that no piece holds side by side: before a mark, and between a letter or
        digit and the ASCII punctuation that follows no ASCII letter or digit in any piece. Word characters that some
        of this punctuation does follow (an underscore, say) are not cut off. ASCII characters of no piece, such as line
        breaks, stand alone.
        """
        before: dict[str, set[str]] = {chr(c): set() for c in range(128) if not re.match(r"\w", chr(c))}
        for p in self.normal:
            for x, c in zip(p, p[1:]):
                if c in before and re.match(r"\w", x):
                    before[c].add(x)
        apart = {c: xs for c, xs in before.items() if not any(re.match("[A-Za-z0-9]", x) for x in xs)}
        after = "".join(map(re.escape, apart))
        joined = "".join(sorted(set().union(*apart.values())))
        known = set().union(*self.normal)
        alone = "".join(re.escape(c) for c in before if c not in known and c != " ")
        letter = rf"[^\W{re.escape(joined)}]"
        words = rf"{MARK}*{letter}++(?![^{MARK}{after}])|{MARK}*[^{MARK}{alone}]+|{MARK}+"
        return re.compile((f"{words}|[{alone}]" if alone else words) if self.splits else "(?s).+")

    def _merged(self, text: str) -> tuple[list[int], dict[int, tuple[int, int]]]:
        """Plain merging, best score first, then leftmost: the ids, and the two ids that each merge joined."""
        parts, joins = list(text), {}
        while len(parts) > 1:
            found = [(-self.score[i], k, i) for k in range(len(parts) - 1) if (i := self.normal.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                break
            _, k, i = min(found)
            joins[i] = self.normal.get(parts[k], NONE), self.normal.get(parts[k + 1], NONE)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.normal.get(p, NONE) for p in parts], joins

    def _learn_joins(self) -> None:
        """The two halves that each piece is merged from, and when: pieces come up in the order of their scores.

        Pieces that merging never gives are left out of the automaton. ``self.plain`` are pieces made of pieces of
        better scores all the way down, and of a score of their own; only for those does the order hold.
        """
        times = Counter(self.score[i] for i in self.normal.values())
        self.halves, self.made, self.plain, reached = {}, {}, set(), []
        for piece, i in sorted(self.normal.items(), key=lambda x: len(x[0])):
            if len(piece) == 1:
                self.made[i] = float("-inf")
                self.plain.add(i)
                reached.append((piece, i))
                continue
            ids, joins = self._merged(piece)
            if ids != [i]:
                continue
            reached.append((piece, i))
            self.made[i], self.halves[i] = -self.score[i], joins[i]
            if times[self.score[i]] == 1 and all(h in self.plain and self.made[h] < self.made[i] for h in joins[i]):
                self.plain.add(i)
        for piece, i in reached:
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()

    def _undisturbed(self, left: int, right: int) -> bool:
        """Whether no merge across the border comes before both pieces are complete.

        At any time one part of the left piece and one part of the right touch the border. Going back in time, the
        part that was made last gives way to its half at the border.
        """
        u, v, until_u, until_v = left, right, float("inf"), float("inf")
        while True:
            across = self.normal.get(self.pieces[u] + self.pieces[v])
            if across is not None and (at := -self.score[across]) < until_u and at <= until_v:
                return False
            if self.made[u] > self.made[v]:
                until_u, u = self.made[u], self.halves[u][1]
            elif v in self.halves:
                until_v, v = self.made[v], self.halves[v][0]
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces side by side are encoded as these two. An unknown character goes with everything."""
        if left == NONE or right == NONE:
            return True
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) > REMEMBERED:
                self._pairs.clear()
            if left in self.plain and right in self.plain:
                known = self._undisturbed(left, right)
            else:
                known = self._merged(self.pieces[left] + self.pieces[right])[0] == [left, right]
            self._pairs[left, right] = known
        return known

    def prefix_table(self, text: str) -> list[int]:
        """For each prefix that ends after character i: its last token.

        Where no piece fits, the character is outside the vocabulary and stands alone (``NONE``).
        """
        last = [NONE] * len(text)
        pairs, settled = self._pairs, NONE
        for end, (token, length) in self.automaton.iter(text):
            if end != settled:
                before = end - length
                if before >= 0 and (left := last[before]) != NONE:
                    fits = pairs.get((left, token))
                    if fits is None:
                        fits = self.compatible(left, token)
                    if not fits:
                        continue
                last[end], settled = token, end
        return last

    def word(self, text: str) -> bytes:
        """Ids of a text without begin and end, in 32 bits each, recovered backwards from the prefix table."""
        last = self.prefix_table(text)
        out, i, width = [], len(text) - 1, self.width
        while i >= 0:
            token = last[i]
            if token == NONE:
                out.extend(self.byte_ids[b] for b in reversed(text[i].encode()))
                i -= 1
            else:
                out.append(token)
                i -= width[token]
        out.reverse()
        return array("I", out).tobytes()

    def encode(self, text: str) -> array:
        """Ids with begin and end."""
        ids = array("I", [self.begin])
        if text:
            words = self._word.findall(MARK + text.replace(" ", MARK))
            ids.frombytes(b"".join(map(self._words.__getitem__, words)))
            if len(self._words) > REMEMBERED:
                self._words.clear()
        ids.append(self.end)
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: byte pieces joined to characters, marks to spaces, without the one put in front."""
        ids = ids if isinstance(ids, array) else list(ids)
        text = "".join(map(self.shown.__getitem__, ids))
        if text[:1] == " " and next(i for i in ids if i not in self.silent) != self.unknown:
            text = text[1:]
        return BYTES.sub(_characters, text) if BYTES.search(text) else text


def _characters(run: re.Match) -> str:
    """UTF-8 with one replacement character for each byte that belongs to no character."""
    out, i, data = [], 0, bytes(ord(c) - BYTE_MARK for c in run[0])
    while i < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


class _Words(dict):
    """Words and their ids; a missing one is encoded, and remembered unless it is long."""

    def __init__(self, encoder: BpeModel):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        ids = self.encoder.word(word)
        if len(word) <= REMEMBERED_LENGTH:
            self[word] = ids
        return ids


def model(model_file: str) -> BpeModel:
    return remembered(("sentencepiece", model_file), lambda: BpeModel(model_file))


def encode_texts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and decoded text of each row. A null text is encoded as the empty one: begin and end only.

    Whole texts of any length, one row out for each row in; repeated and null ids stay as they are, an empty table
    gives an empty one, other columns are left out. ``model_file`` must be readable on every executor.
    """

    def rows(ids: list, texts: list):
        m = model(model_file)
        for doc_id, text in zip(ids, texts):
            tokens = m.encode((text or b"").decode())
            yield doc_id, tokens.tolist(), m.decode(tokens)

    return map_texts(documents_of(docs, id_col, text_col), rows, "doc_id long, ids array<int>, decoded string")


def token_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number and digest of the ids that ``encode_texts`` gives, and the digest of the decoded text, in the same pass."""

    def rows(ids: list, texts: list):
        m = model(model_file)
        for doc_id, text in zip(ids, texts):
            tokens = m.encode((text or b"").decode())
            decoded = m.decode(tokens).encode()
            yield doc_id, len(tokens), sha256(little_endian(tokens)).hexdigest(), sha256(decoded).hexdigest()

    return map_texts(documents_of(docs, id_col, text_col), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def little_endian(tokens: array) -> bytes:
    """Unsigned 32-bit integers, least byte first."""
    if sys.byteorder == "big":
        tokens = array("I", tokens)
        tokens.byteswap()
    return tokens.tobytes()
