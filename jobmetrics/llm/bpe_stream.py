"""Byte-pair encoding and decoding as streams: a token leaves as soon as nothing that may follow can change it.

Merges happen in the order of the merge list. What is appended to a text changes merges further left only through a chain of
merges of rising rank, each of which joins the token before the place where two readings differ with the token
behind it. The merge list says how many symbols such a chain can span (``sufficient_lookahead``), so tokens that end so far
before the end of what has been read are final. The encoder keeps a window of that order, whatever the length of
the text; between two of its pieces it keeps at most the word that is not finished, and of that only its window.

The decoder is a byte-to-text state machine whose state is the unfinished character.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain, groupby

from pyspark.sql import DataFrame

from jobmetrics.llm.batches import documents_of, map_texts

WORD_END = "</w>"
#: Comes after every merge.
NEVER = (1 << 60, -1)
#: Words, and stretches between spaces, that a worker remembers at a time, and the longest that it does, in characters.
REMEMBERED, REMEMBERED_LENGTH = 1 << 18, 32
#: Characters of a text read at a time, and of an unfinished word kept before its symbols are passed on.
PIECE, HELD = 1 << 16, 1 << 10
#: Symbols of an unfinished word beyond the lookahead that are gathered before tokens leave.
SLACK = 1 << 10


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: its own where there is one, else the next free from 256 on."""
    shown, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            shown.append(chr(b))
        else:
            shown.append(chr(free))
            free += 1
    return shown


def sufficient_lookahead(merges: list[tuple[str, str]], width) -> int:
    """Symbols after a token that settle it, from the merge list alone; ``width`` gives a token's number of symbols.

    ``reach[x]`` is the longest chain so far whose last merge has ``x`` as its first half. A merge of (x, y) continues a chain
    that ended with the first half s only if y begins with s, and if s was still whole when that chain's last merge happened.
    """
    reach: dict[str, int] = {}
    first: dict[str, str] = {}
    then: dict[str, int] = {}
    most = 0
    for x, y in merges:
        best, part = reach.get(y, 0), y
        while part in first:
            best = max(best, then[part])
            part = first[part]
        best += width(x)
        reach[x] = max(reach.get(x, 0), best)
        first[x + y], then[x + y] = x, reach[x]
        most = max(most, best)
    return most


class StreamBpe:
    """Vocabulary, merges and text rules of a byte-level BPE file with word ends, lower case and no pieces for spaces.

    The merge list must be proper: each token is made by one merge, after both its halves. ``ValueError`` otherwise.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        with open(vocabulary, encoding="utf-8") as f:
            content = json.load(f)
        model = content["model"]
        if model.get("end_of_word_suffix") != WORD_END or model.get("dropout") or content.get("decoder"):
            raise ValueError("not a BPE file with word ends and without a decoder")
        #: The file's own rules for characters, asked only about characters on which Unicode versions differ.
        self._rules = Tokenizer.from_file(vocabulary)
        shown = byte_characters()
        ids = model["vocab"]
        self.name = {i: t for t, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.name |= {i: t for t, i in self.special.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made: dict[str, int] = {}
        for rank, (x, y) in enumerate(merges):
            if x + y in made or made.get(x, -1) >= rank or made.get(y, -1) >= rank:
                raise ValueError("the merge list is not proper")
            made[x + y] = rank
        if any(part not in made and part.removesuffix(WORD_END) not in shown for pair in merges for part in pair):
            raise ValueError("a merge uses a token that nothing makes")
        self.rank = {(ids[x], ids[y]): (rank, ids[x + y]) for rank, (x, y) in enumerate(merges)}
        self.width = {i: len(t.removesuffix(WORD_END)) for t, i in ids.items()}
        self.lookahead = sufficient_lookahead(merges, lambda t: len(t.removesuffix(WORD_END)))
        self.inside = [ids[c] for c in shown]
        self.last = [ids[c + WORD_END] for c in shown]
        byte_of = {c: b for b, c in enumerate(shown)}
        self.bytes_of = {i: bytes(byte_of[c] for c in t.removesuffix(WORD_END)) for t, i in ids.items()}
        self.ends_word = {i for t, i in ids.items() if t.endswith(WORD_END)}
        self._text_rules()
        self.words = _Remembered(self._word)
        self.segments = _Remembered(self._segment)

    def _text_rules(self) -> None:
        """Characters that Python's Unicode tables do not have, or put elsewhere, are put where the file's rules put them."""
        ask = self._rules.normalizer.normalize_str
        kinds = {c: unicodedata.category(chr(c)) for c in chain(range(0xD800), range(0xE000, 0x40000))}
        new = [chr(c) for c, kind in kinds.items() if kind == "Cn"]
        marks = [chr(c) for c, kind in kinds.items() if kind[0] == "M" and unicodedata.combining(chr(c))]
        # Marks in an order that normalisation has to mend show whether both sides rank them alike.
        order = [f"x\u0301{c}\u0334x" for c in marks]
        odd = {c for c, mine, theirs in zip(marks, map(_normal, order), ask("|".join(order)).split("|")) if mine != theirs}
        odd |= {c for c, theirs in zip(new, ask("|".join(new)).split("|")) if _normal(c) != theirs}
        self._odd = re.compile(f"[{_ranges(odd)}]") if odd else None
        placed = self._classes(new)
        letters = _ranges({chr(c) for c, kind in kinds.items() if kind[0] == "L"} | {c for c, kind in placed.items() if kind == "letter"})
        digits = _ranges({chr(c) for c, kind in kinds.items() if kind[0] == "N"} | {c for c, kind in placed.items() if kind == "digit"})
        # The endings that are words of their own, the order of the alternatives, and white space.
        spaces = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.word = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{spaces}{letters}{digits}]+")
        self.letters, self.others = re.compile(rf"[{letters}]+"), re.compile(rf"[^{spaces}{letters}{digits}]+")
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.longest_mark = max(map(len, self.special), default=0)

    def _classes(self, characters: list[str]) -> dict[str, str]:
        """A letter between two letters makes one word with them, anything else three; digits stand one by one."""
        ask = self._rules.pre_tokenizer.pre_tokenize_str
        words = [0] * len(characters)
        for _, (start, _) in ask("".join(f"a{c}a " for c in characters)):
            words[start // 4] += 1
        apart = [c for c, n in zip(characters, words) if n > 1]
        twice = [0] * len(apart)
        for _, (start, _) in ask("".join(f"{c}{c} " for c in apart)):
            twice[start // 3] += 1
        found = {c: "letter" for c, n in zip(characters, words) if n == 1}
        return found | {c: "digit" if n > 1 else "other" for c, n in zip(apart, twice)}

    def normal(self, text: str) -> str:
        """Composed characters in lower case. White space needs no care, as it is in no word."""
        if text.isascii():
            return text.lower()
        if self._odd is not None and self._odd.search(text):
            return self._rules.normalizer.normalize_str(text)
        return _normal(text)

    def merged(self, symbols: list[int]) -> list[int]:
        """All merges of a sequence of symbols: the best rank first, then leftmost."""
        n, rank = len(symbols), self.rank
        if n < 24:
            parts = list(symbols)
            after = [rank.get(pair, NEVER) for pair in zip(parts, parts[1:])]
            while after and (best := min(after)) is not NEVER:
                k = after.index(best)
                parts[k : k + 2] = [best[1]]
                del after[k]
                if k:
                    after[k - 1] = rank.get((parts[k - 1], parts[k]), NEVER)
                if k < len(after):
                    after[k] = rank.get((parts[k], parts[k + 1]), NEVER)
            return parts
        parts, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(r[0], k, parts[k], parts[k + 1]) for k in range(n - 1) if (r := rank.get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(waiting)
        while waiting:
            _, k, x, y = heapq.heappop(waiting)
            other = after[k]
            if parts[k] != x or other >= n or parts[other] != y:
                continue
            parts[k], parts[other] = rank[x, y][1], -1
            after[k] = after[other]
            if after[k] < n:
                before[after[k]] = k
            for at in (before[k], k):
                if at >= 0 and after[at] < n and (r := rank.get((parts[at], parts[after[at]]))) is not None:
                    heapq.heappush(waiting, (r[0], at, parts[at], parts[after[at]]))
        return [p for p in parts if p >= 0]

    def _word(self, word: str) -> bytes:
        data = word.encode()
        if len(data) <= SLACK:  # all of it is in the window
            inside = self.inside
            return array("I", self.merged([*(inside[b] for b in data[:-1]), self.last[data[-1]]])).tobytes()
        merger = Merger(self)
        out = merger.push(data)
        out.extend(merger.finish())
        return out.tobytes()

    def _segment(self, text: str) -> bytes:
        """Ids of what stands between two spaces: words end there."""
        return b"".join(map(self.words.__getitem__, self.word.findall(text)))

    def encode(self, text: str) -> array:
        out = array("I")
        for ids in self.pieces([text[i : i + PIECE] for i in range(0, len(text), PIECE)]):
            out.extend(ids)
        return out

    def pieces(self, texts: Iterable[str]) -> Iterator[array]:
        """Ids of the texts set end to end, as they become certain."""
        encoder = Encoder(self)
        for text in texts:
            yield encoder.feed(text)
        yield encoder.finish()

    def tokens(self, ids: Iterable[int]) -> str:
        """What the library's ``decode`` gives for a file without a decoder: the tokens as they are written, a space between two."""
        return " ".join(map(self.name.__getitem__, ids))


def _ranges(characters: set[str]) -> str:
    """A set of characters as the inside of a character class."""
    out, codes = [], sorted(map(ord, characters))
    for _, run in groupby(enumerate(codes), lambda x: x[1] - x[0]):
        run = [c for _, c in run]
        out.append(f"\\U{run[0]:08x}-\\U{run[-1]:08x}")
    return "".join(out)


def _normal(text: str) -> str:
    composed = unicodedata.normalize("NFC", text)
    # Each character by itself: the sigma at the end of a word is a rule for whole words.
    return "σ".join(part.lower() for part in composed.split("Σ"))


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Characters that can combine with the one before them, besides combining marks."""
    second = {chr(c) for c in chain(range(0x1161, 0x1176), range(0x11A8, 0x11C3))}
    for c in map(chr, chain(range(0xAC00), range(0xD7A4, 0xD800), range(0xE000, 0x30000))):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            second.add(chr(int(parts[1], 16)))
    return frozenset(second)


def starts_anew(c: str) -> bool:
    """Whether normalisation never joins this character with, or moves it before, one in front of it."""
    if c.isascii():
        return True
    first = unicodedata.normalize("NFD", c)[0]
    return not unicodedata.combining(first) and first not in _joining() and c not in _joining() and unicodedata.category(c) != "Cn"


class _Remembered(dict):
    """What a function gives for short texts; it starts anew when it is full."""

    def __init__(self, work: Callable[[str], bytes]):
        super().__init__()
        self.work = work

    def __missing__(self, text: str) -> bytes:
        ids = self.work(text)
        if len(text) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[text] = ids
        return ids


class Merger:
    """Symbols of one word in, tokens out. It holds fewer than twice the lookahead and ``SLACK`` symbols."""

    def __init__(self, model: StreamBpe):
        self.model, self.waiting = model, array("I")

    def push(self, data: bytes) -> array:
        """The tokens that are certain now. The last symbol read may turn out to be the word's last, so it settles nothing."""
        m, out = self.model, array("I")
        limit = m.lookahead + SLACK
        for low in range(0, len(data), SLACK):
            self.waiting.extend(map(m.inside.__getitem__, data[low : low + SLACK]))
            if len(self.waiting) <= limit:
                continue
            certain, at = len(self.waiting) - 1 - m.lookahead, 0
            for token in m.merged(self.waiting):
                end = at + m.width[token]
                if end > certain:
                    break
                out.append(token)
                at = end
            # What follows a settled token is merged as if it stood alone.
            self.waiting = self.waiting[at:]
        return out

    def finish(self) -> array:
        """The tokens of the rest of the word."""
        m = self.model
        if self.waiting:
            self.waiting[-1] = m.last[m.inside.index(self.waiting[-1])]
        out = array("I", m.merged(self.waiting))
        self.waiting = array("I")
        return out


class Encoder:
    """Text in, in pieces of any size; ids out, as they become certain.

    Kept between pieces: characters that may belong to a special token or still combine (``raw``), the unfinished word
    (``text``), and of a word that is longer than ``HELD`` its merger alone (``run``, with the pattern that continues it).
    """

    def __init__(self, model: StreamBpe):
        self.model, self.raw, self.text = model, "", ""
        self.run: tuple[re.Pattern, Merger] | None = None

    def feed(self, text: str) -> array:
        return self._read(self.raw + text, False)

    def finish(self) -> array:
        return self._read(self.raw, True)

    def _read(self, raw: str, end: bool) -> array:
        m, out, at = self.model, array("I"), 0
        for mark in m.marks.finditer(raw) if m.marks else ():
            self._plain(raw[at : mark.start()], True, out)
            out.append(m.special[mark[0]])
            at = mark.end()
        stop = len(raw)
        if not end:
            stop = max(at, stop - max(0, m.longest_mark - 1))
            while stop > at and not starts_anew(raw[stop]) if stop < len(raw) else stop > at:
                stop -= 1
        self._plain(raw[at:stop], end, out)
        self.raw = raw[stop:]
        return out

    def _plain(self, raw: str, end: bool, out: array) -> None:
        m = self.model
        text = self.text + m.normal(raw)
        if self.run:
            pattern, merger = self.run
            more = pattern.match(text)
            size = more.end() if more else 0
            out.extend(merger.push(text[:size].encode()))
            if size == len(text) and not end:
                self.text = ""
                return
            out.extend(merger.finish())
            text, self.run = text[size:], None
        segments = text.split(" ")
        rest = "" if end else segments.pop()
        out.frombytes(b"".join(map(m.segments.__getitem__, segments)))
        self.text = rest
        if len(rest) > HELD:
            self._settle(out)

    def _settle(self, out: array) -> None:
        """Pass on what is certain of a long stretch without spaces."""
        m, words, held = self.model, self.model.word.findall(self.text), 0
        if words and self.text.endswith(words[-1]):
            # The last word may go on, and with a quotation mark before it become an ending.
            held = 2 if len(words) > 1 and len(words[-1]) < 2 and words[-2] == "'" and self.text.endswith("'" + words[-1]) else 1
        out.frombytes(b"".join(map(m.words.__getitem__, words[: len(words) - held])))
        self.text = "".join(words[len(words) - held :])
        if len(self.text) > HELD:
            pattern = m.letters if m.letters.fullmatch(self.text) else m.others
            merger = Merger(m)
            out.extend(merger.push(self.text.encode()))
            self.text, self.run = "", (pattern, merger)


#: UTF-8: how many bytes follow a first byte, and what the next one may be; all other bytes begin nothing.
def _first_bytes() -> dict[int, tuple[int, int, int]]:
    table = {b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)}
    table |= {b: (2, 0x80, 0xBF) for b in range(0xE0, 0xF0)} | {0xE0: (2, 0xA0, 0xBF), 0xED: (2, 0x80, 0x9F)}
    return table | {0xF0: (3, 0x90, 0xBF), 0xF4: (3, 0x80, 0x8F)} | {b: (3, 0x80, 0xBF) for b in range(0xF1, 0xF4)}


FIRST = _first_bytes()


class Decoder:
    """Ids in, text out as soon as characters are complete. A word end is a space, except at the end of the text.

    The state is the begun character: its bytes so far, how many are missing and which may come next. What no character
    can be made of gives one replacement character for each longest beginning of a character.
    """

    def __init__(self, model: StreamBpe):
        self.model, self.begun, self.missing, self.low, self.high, self.space = model, bytearray(), 0, 0x80, 0xBF, ""

    def _bytes(self, data: bytes) -> Iterator[str]:
        for b in data:
            if self.missing:
                if self.low <= b <= self.high:
                    self.begun.append(b)
                    self.missing, self.low, self.high = self.missing - 1, 0x80, 0xBF
                    if not self.missing:
                        yield self.begun.decode()
                        self.begun.clear()
                    continue
                yield self._broken()
            if b < 0x80:
                yield chr(b)
            elif b in FIRST:
                self.missing, self.low, self.high = FIRST[b]
                self.begun.append(b)
            else:
                yield "�"

    def _broken(self) -> str:
        self.begun.clear()
        self.missing, self.low, self.high = 0, 0x80, 0xBF
        return "�"

    def feed(self, ids: Iterable[int]) -> str:
        m, out = self.model, []
        for i in ids:
            data = m.bytes_of.get(i)
            if data is None:  # a special token
                out.append((self._broken() if self.missing else "") + self.space + m.name[i])
                self.space = " "
                continue
            if self.space and self.missing:
                out.append(self._broken())
            out.append(self.space)
            self.space = ""
            if self.missing or not data.isascii():
                out.extend(self._bytes(data))
            else:
                out.append(data.decode())
            if i in m.ends_word:
                self.space = " "
        return "".join(out)

    def finish(self) -> str:
        rest, self.space = self._broken() if self.missing else "", ""
        return rest


@lru_cache(maxsize=2)
def model(vocabulary: str) -> StreamBpe:
    return StreamBpe(vocabulary)


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, and the text that the ids stand for (lower case, a space between words), for each row.

    A null text is encoded as the empty one: no ids. Whole texts of any length, one row out for each row in; repeated and
    null ids stay as they are, an empty table gives an empty one, other columns are left out. ``vocabulary`` must be
    readable on every executor.
    """

    def rows(ids: list, texts: list):
        m = model(vocabulary)
        for doc_id, text in zip(ids, texts):
            tokens, decoder = m.encode((text or b"").decode()), Decoder(m)
            yield doc_id, tokens.tolist(), decoder.feed(tokens) + decoder.finish()

    return map_texts(documents_of(docs, id_col, text_col), rows, "doc_id long, ids array<int>, decoded string")


def token_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number and digest of the ids that ``encode_texts`` gives, and the digest of the library's decoding of them.

    Ids go into the digests as they leave the encoder, so nothing as long as the text is kept beside it.
    """

    def rows(ids: list, texts: list):
        m = model(vocabulary)
        for doc_id, data in zip(ids, texts):
            text, n, of_ids, of_tokens = (data or b"").decode(), 0, sha256(), sha256()
            for out in m.pieces(text[i : i + PIECE] for i in range(0, len(text), PIECE)):
                if out:
                    gap = " " if n else ""
                    of_ids.update((gap + " ".join(map(str, out))).encode())
                    of_tokens.update((gap + m.tokens(out)).encode())
                    n += len(out)
            yield doc_id, n, of_ids.hexdigest(), of_tokens.hexdigest()

    return map_texts(documents_of(docs, id_col, text_col), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
