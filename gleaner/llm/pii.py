"""Personal data by fixed patterns and a linear-chain conditional random field.

Fixed patterns give the base spans of four kinds: email, ip, card and phone. The random field adds
spans that they miss, such as phone numbers without a plus sign or addresses with ``[at]``. It
labels all tokens of a text (runs of letters, runs of digits, single marks) by their word shapes and
those of their neighbours, is trained on a small labelled table by gradient ascent on the
likelihood, and is decoded by Viterbi for many chains at once.

Every token enters the decoding. Most of them need no Viterbi step, as their state is proved: for a
token in the context of its neighbours a table has the most that any state could win over outside.
If the sums of these bounds and of the steps between states stay below zero for all runs of tokens
that hold it, some best path has it outside. What is left falls into stretches between outside
tokens, each a chain. So the result is that of Viterbi on the whole text.

An added span must hold together as its kind does (digits of a phone, Luhn sum of a card, parts of
an address) and overlaps no base span.

Places count code points. A null or empty text has no spans; repeated rows give equal results;
an empty table gives no rows. All other columns pass through :func:`redact` unchanged.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gleaner.llm.common import TEXT_ROWS, documents, ranges, text_or_empty, trimmed

KINDS = ("email", "ip", "card", "phone")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGIT, _NO_DIGIT = re.compile("[0-9]"), re.compile("[^0-9]+")
#: Rounds of gradient ascent, its step, the penalty of large weights, cells of a batch of chains.
ROUNDS, RATE, RIDGE, CELLS = 80, 0.15, 1e-3, 1 << 18
#: Weight of a pair of shapes for a state in which the labelled table never has it.
UNSEEN = -2.0
#: Parts of one in which bounds of gains are kept.
UNIT = 4
#: Characters whose tokens are decoded together.
GROUP_CHARS = 1 << 20


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str) -> list[tuple[int, int]]:
    """At signs from left to right: the run of local characters before each, then the domain."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        # a run of local characters ends at its at sign, so it is found backwards, stretch by stretch
        size, start = 64, at
        while start > end:
            low = max(end, at - size)
            piece = text[low:at][::-1]
            start = at - _LOCAL_END.match(piece).end()
            if start > low or low == end:
                break
            size *= 4
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
            at = text.find("@", end)
        else:
            end = at + 1
            at = text.find("@", end)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost matches of each kind's pattern that do not overlap; those that fail its test go."""
    out = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if _DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return out


_DOT = r"(?:\.|\s+(?:\.|dot|punto|punkt|point)\s+|\s*[\[({]\s*(?:\.|dot|punto|punkt|point)\s*[\])}]\s*)"
_AT = r"(?:\s*@\s*|\s+(?:at|arroba|arobase)\s+|\s*[\[({]\s*(?:@|at|arroba|arobase)\s*[\])}]\s*)"
_ADDRESS = re.compile(rf"[A-Za-z0-9_%+-]+(?:{_DOT}[A-Za-z0-9_%+-]+)*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.IGNORECASE)


def _plausible(kind: str, found: str) -> bool:
    digits = _NO_DIGIT.sub("", found)
    if kind == "phone":
        return 10 <= len(digits) <= 15 and len(found) <= 30 and not re.search("[A-Za-z]", found)
    if kind == "card":
        return 16 <= len(digits) <= 19 and len(found) <= 40 and luhn(digits)
    if kind == "ip":
        parts = re.findall("[0-9]+", found)
        return len(parts) == 4 and all(map(_small, parts))
    return len(found) <= 120 and bool(_ADDRESS.fullmatch(found))


#: Sentences of the labelled table; a slot names the kind of what fills it.
SENTENCES = (
    "Please write to <email> before Monday.", "My address is <email> at work", "<email> wrote this note", "Contact: <email>, room 12", "mail <email> or call <phone>",
    "Call me on <phone> tonight", "tel. <phone> (home)", "phone <phone>", "Her number was <phone>, I think.", "Fax: <phone>; open 9 to 17", "call <phone> now", "text <phone> please",
    "The server at <ip> is down", "ping <ip> failed 3 times", "login from <ip> on port 8080", "host <ip>", "Traffic to <ip>, then to <ip>.",
    "Card <card> was charged 25 dollars", "pay with <card> please", "my card number is <card>.", "VISA <card> exp 09/27",
    "In 1998 we sold 1,250 cars for $3,400.50 each.", "Version 2.14.3 of the tool came in 2019", "see pages 120-134 and 12.5 of volume 3", "token = \"<hex>\" must stay secret",
    "Order 20391 of 2021-03-14 has 12 parts", "at 10:45 the train left for (old) York", "chapter 3.1 and section 4.2.1 (new)", "score 3-1, then 12-9", "@home and @work are tags", "It is 20 x 30 cm, or 8 in.",
    "serial <hex> and part <digits>", "number <digits> in line", "the id <digits> (see table 4)", "und <digits>! die 14 der 3.", "les 25, que 31.",
    "und <phone> der", "<phone>!!", "des <ip>. De", "la <email> que", "el <card> y", "for (see note) 12 or [at] night 14", "mail to <digits>",
    "Schreib an <email> bis Montag", "Telefon <phone> im Haus", "die Karte <card> ist neu", "der Rechner <ip> steht still", "am 14. Mai 2020 um 9 Uhr, Seite 12",
    "Ecrivez a <email> avant lundi", "appelez le <phone> ce soir", "la carte <card> est bloquee", "le serveur <ip> ne marche pas", "le 3 mars 1999, page 48 et 49",
    "Escribe a <email> el lunes", "llama al <phone> hoy", "mi tarjeta <card> no va", "el servidor <ip> ha caido", "el 12 de junio de 2008, hoja 7",
    "we met at the house near the dot on the map", "she is at home and he is at work, the point is new", "look at this. And that, at last", "punto y coma, el punto final", "the 3 of us at 5 and 6 dot 7",
    "<word> <word> at <word>. <Word> <word> <word>", "<Word> at <word> by <word> <word>.", "<word>, at <word> and <word>. At <word> the <word>", "<WORD>!! <WORD> AT!! <WORD>, <WORD>.", "<word> <word> <word> <word>, <word>. <Word> <word>",
    "<word> at the <word>", "<Word> <word> at <word> <word>. <Word>, <word> at <word>", "<word>. <Word>. <word> at. <Word> <word>", "| <word> | <digits> | <Word> |", "<word> | at | <word>", "<word> mail <word> phone <word> card <word> host <word> call <word>",
    "<word>, <email>, <phone>; <email>", "<email>; <card>; <ip>", "(<email>) or (<phone>)", "<word> <email>. <Word> <phone>.", "<phone> or <phone>, <email>", "Send it to <email> today", "<email> is mine", "<email> knows <word>", "<Word> <email> <word>", "<ip>, <ip> and <phone>", "<word> by <card> <word>", "<Word> <word> <ip> <word>", "<word>: <phone>, <card>",
    "order <digits> <digits> shipped", "rows <digits>, <digits>, <digits> and <digits>", "| <digits> | <digits> | <digits> |", "a - b - c * d | e", "1. one 2. two 3. three 4. four",
)


def labelled_table(seed: int = 7, copies: int = 12) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, spans): the sentences with slots filled from a seeded rule, spans as (kind, start, end)."""
    rnd = random.Random(seed)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 8)))

    def card() -> str:
        body = rnd.choice("3456") + digits(14)
        return body + next(d for d in "0123456789" if luhn(body + d))

    def fill(kind: str) -> str:
        if kind == "email":
            parts, host, top = rnd.choice([[word()], [word(), word()], [word(), digits(2)]]), word() + rnd.choice(["", "", digits(1)]), rnd.choice(["com", "org", "net", "de", "fr", "es"])
            user = ".".join(parts)
            at, dot = rnd.choice([("at", "dot"), ("at", "punkt"), ("arroba", "punto"), ("arobase", "point"), ("AT", "DOT")])
            worded = f" {dot} ".join(parts) + f" {at} {host} {dot} {top}"
            return rnd.choice([f"{user}@{host}.{top}", f"{user}[at]{host}.{top}", f"{user} [at] {host} [dot] {top}", f"{user} (at) {host} (dot) {top}", f"{user}(at){host}.{top}", f"{user} @ {host}.{top}", f"{user} @ {host} . {top}", worded, worded, f"{user} {at} {host}.{top}"])
        if kind == "ip":
            parts = [str(rnd.randint(1, 255)) for _ in range(4)]
            return rnd.choice([".".join(parts), "[.]".join(parts), " . ".join(parts), "(.)".join(parts), " dot ".join(parts), "[dot]".join(parts)])
        if kind == "card":
            c = card()
            return rnd.choice([c, *(mark.join(c[i : i + 4] for i in range(0, 16, 4)) for mark in (" ", ".", "/", "  ", " - "))])
        if kind == "phone":
            a, b, c = digits(3), digits(3), digits(4)
            return rnd.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a} / {b} {c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b} {c}", f"00{digits(2)} {a} {b}{c}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"0{digits(2)}/{digits(7)}"])
        if kind.lower() == "word":
            return word().upper() if kind.isupper() else word().title() if kind.istitle() else word()
        return "".join(rnd.choice("0123456789abcdef") for _ in range(rnd.randint(24, 40))) if kind == "hex" else digits(rnd.choice([1, 2, 3, 4, 5, 7, 8, 10, 11, 16]))

    out = []
    for _ in range(copies):
        for sentence in SENTENCES:
            text, spans = "", []
            for part in re.split(r"(<\w+>)", sentence):
                if part[:1] == "<":
                    kind, value = part[1:-1], fill(part[1:-1])
                    if kind in KINDS:
                        spans.append((kind, len(text), len(text) + len(value)))
                    part = value
                text += part
            out.append((text, spans))
    return out


#: Words that are shapes of their own.
WORDS = ("at", "arroba", "arobase", "dot", "punkt", "punto", "point", "tel", "telefon", "phone", "call", "fax", "mail", "ip", "host", "server", "card", "visa")
#: Shapes: a text's begin and end, digits by length, letters by case and length, marks, others, words.
BEGIN, END, DIGITS, LETTERS, MARKS = 0, 1, 2, 19, 31
_SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]
OTHER = MARKS + len(_SIGNS)
SHAPES = OTHER + 1 + len(WORDS)
_CLASS = np.full(129, 3, np.int8)  # 0 space, 1 letter, 2 digit, 3 mark; 128 stands for all that is not ASCII
_CLASS[[32, *range(9, 14), *range(28, 32)]] = 0
_CLASS[[*range(65, 91), *range(97, 123), 128]] = 1
_CLASS[48:58] = 2
_MARK = np.full(129, OTHER)
_MARK[_SIGNS] = MARKS + np.arange(len(_SIGNS))


def _key(word: str) -> int:
    return int.from_bytes(word.encode(), "little")


_KEYS = np.array(sorted(map(_key, WORDS)), np.uint64)
_KEY_SHAPES = np.array([OTHER + 1 + WORDS.index(k.to_bytes(8, "little").rstrip(b"\0").decode()) for k in _KEYS.tolist()])
_HEADS = np.zeros((128, 9), bool)
for _w in WORDS:
    _HEADS[ord(_w[0]), len(_w)] = True


class Tokens:
    """Tokens of many texts: begin and end in the joined texts, shape, gap before; each text's stand
    between a begin and an end token, whose places are ``edges``."""

    def __init__(self, texts: list[str]):
        codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.minimum(codes, 128).astype(np.uint8)
        kind = _CLASS[low]
        real, mark = kind != 0, kind == 3
        change = kind[1:] != kind[:-1]
        first = np.flatnonzero(real & (np.append(True, change) | mark))
        last = np.flatnonzero(real & (np.append(change, True) | mark)) + 1
        size, of = last - first, kind[first]
        upper = np.append(0, np.cumsum((low >= 65) & (low <= 90), dtype=np.int32))
        lower = np.append(0, np.cumsum((low >= 97) & (low <= 122), dtype=np.int32))
        n_upper, n_lower = upper[last] - upper[first], lower[last] - lower[first]
        case = np.where(n_upper == 0, 0, np.where(n_lower == 0, 1, 2))
        shape = np.where(of == 2, DIGITS + np.minimum(size, 17) - 1, np.where(of == 1, LETTERS + 4 * case + np.minimum(size, 4) - 1, _MARK[low[first]]))
        folded = low | ((low >= 65) & (low <= 90)).astype(np.uint8) << 5
        some = np.flatnonzero((of == 1) & (size <= 8))
        some = some[_HEADS[np.minimum(folded[first[some]], 127), size[some]]]
        if len(some):
            keys = np.zeros(len(some), np.uint64)
            for i in range(8):
                on = size[some] > i
                keys[on] |= folded[first[some[on]] + i].astype(np.uint64) << np.uint64(8 * i)
            at = np.minimum(np.searchsorted(_KEYS, keys), len(_KEYS) - 1)
            known = _KEYS[at] == keys
            shape[some[known]] = _KEY_SHAPES[at[known]]
        self.offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cuts = np.searchsorted(first, self.offsets)
        place = np.arange(len(first)) + 2 * np.repeat(np.arange(len(texts)), np.diff(cuts)) + 1
        total = len(first) + 2 * len(texts)
        self.edges = np.ones(total, bool)
        self.edges[place] = False
        self.first, self.last, self.shape, self.gap = (np.zeros(total, np.int64) for _ in range(4))
        self.first[place], self.last[place], self.shape[place] = first, last, shape
        begins = cuts[:-1] + 2 * np.arange(len(texts))
        self.shape[begins], self.shape[cuts[1:] + 2 * np.arange(len(texts)) + 1] = BEGIN, END
        self.begins = begins
        self.gap[1:] = (self.first[1:] > self.last[:-1]) & ~self.edges[1:] & ~self.edges[:-1]


class Crf:
    """Weights of features and of steps between states: outside, and begin and inside of each kind.

    A token's features are its shape, those of its neighbours, both pairs with the gap between them,
    and the three shapes at once where the labelled table has them.
    """

    STATES = 1 + 2 * len(KINDS)
    PAIRS = 2 * SHAPES * SHAPES

    def __init__(self, triples: np.ndarray):
        self.triples = triples  # ascending codes of those that have weights
        self.emit = np.zeros((3 * SHAPES + 2 * self.PAIRS + len(triples) + 1, self.STATES))
        self.step = np.zeros((self.STATES, self.STATES))
        self.stay, self.enter = np.zeros(len(KINDS)), np.zeros(len(KINDS))

    @staticmethod
    def codes(shape: np.ndarray) -> np.ndarray:
        """Codes of a token's shape between those of its neighbours."""
        before, after = np.append(END, shape[:-1]), np.append(shape[1:], BEGIN)
        return (before * SHAPES + shape) * SHAPES + after

    def features(self, shape: np.ndarray, gap: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A row of feature numbers for each token in ``at``."""
        before, here, after = shape[np.maximum(at - 1, 0)], shape[at], shape[np.minimum(at + 1, len(shape) - 1)]
        return self.numbered(before, gap[at], here, gap[np.minimum(at + 1, len(gap) - 1)], after)

    def numbered(self, before, gap_before, here, gap_after, after) -> np.ndarray:
        code = (before * SHAPES + here) * SHAPES + after
        none = self.emit.shape[0] - 1
        if len(self.triples):
            k = np.minimum(np.searchsorted(self.triples, code), len(self.triples) - 1)
            third = np.where(self.triples[k] == code, 3 * SHAPES + 2 * self.PAIRS + k, none)
        else:
            third = np.full(code.shape, none)
        left, right = (before * 2 + gap_before) * SHAPES + here, (here * 2 + gap_after) * SHAPES + after
        return np.stack([here, SHAPES + before, 2 * SHAPES + after, 3 * SHAPES + left, 3 * SHAPES + self.PAIRS + right, third], -1)

    def finish(self) -> "Crf":
        """Make, for begin and inside of each kind, the table of what it wins over outside, by a token and its neighbours."""
        self.gains = np.zeros((self.STATES - 1, SHAPES, SHAPES, 2, 2, SHAPES), np.int8)  # state, here, before, gaps, after
        before, gap_before, gap_after, after = np.ix_(np.arange(SHAPES), np.arange(2), np.arange(2), np.arange(SHAPES))
        for here in range(SHAPES):
            grid = np.broadcast_arrays(before, gap_before, np.array(here), gap_after, after)
            total = sum(self.emit[x] for x in np.moveaxis(self.numbered(*grid), -1, 0))
            gain = np.ceil((total[..., 1:] - total[..., :1]) * UNIT)  # rounded up, so still a bound
            if gain.max() > 127:
                raise ValueError("weights are too large for the table of gains")
            self.gains[:, here] = np.moveaxis(np.maximum(gain, -128), -1, 0)
        self.gains = self.gains.reshape(self.STATES - 1, -1)
        step, outer = self.step, np.arange(self.STATES) % 2 == 1
        outer[0] = True
        for k in range(len(KINDS)):
            own = slice(2 * k + 1, 2 * k + 3)
            self.stay[k] = step[own, 2 * k + 2].max() - step[0, 0]
            self.enter[k] = (step[:, 2 * k + 1] - step[:, 0]).max() + (step[own] - step[0])[:, outer].max()
        return self

    def open_places(self, tokens: Tokens) -> np.ndarray:
        """Tokens whose state is not proved to be outside.

        A span of a kind wins over outside no more than ``enter``, the gain of begin at its first
        token, and ``stay`` and the gain of inside for every further one. The most that any span over
        a token can win is the sum of the best begin up to there and the best end from there on.
        """
        shape, gap = tokens.shape, tokens.gap
        before, after, then = np.append(END, shape[:-1]), np.append(shape[1:], BEGIN), np.append(gap[1:], 0)
        context = (((shape * SHAPES + before) * 2 + gap) * 2 + then) * SHAPES + after
        out = np.zeros(len(shape), bool)
        for k in range(len(KINDS)):
            inside = self.gains[2 * k + 1][context] / UNIT + self.stay[k]
            inside[tokens.edges] = -1e7  # no span leaves its text
            sums = np.cumsum(inside)
            begin = np.maximum.accumulate(self.gains[2 * k][context] / UNIT - sums)
            out |= begin + np.maximum.accumulate(sums[::-1])[::-1] + self.enter[k] > -1e-2
        return out & ~tokens.edges

    def decode(self, tokens: Tokens, whole: bool = False) -> list[tuple[int, int, int]]:
        """Likeliest spans as (kind, first token, last token); ``whole``: by Viterbi on all tokens."""
        live = ~tokens.edges if whole else self.open_places(tokens)
        change = np.diff(np.concatenate([[0], live.astype(np.int8), [0]]))
        starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        places = np.flatnonzero(live)
        scores = np.zeros((len(places), self.STATES))
        for i in range(0, len(places), 1 << 16):
            scores[i : i + (1 << 16)] = self.emit[self.features(tokens.shape, tokens.gap, places[i : i + (1 << 16)])].sum(1)
        cuts = np.append(0, np.cumsum(ends - starts))
        paths = self.viterbi([scores[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())])
        out = []
        for start, path in zip(starts.tolist(), paths):
            for k in np.flatnonzero(path % 2 == 1).tolist():
                j = k + 1
                while j < len(path) and path[j] == path[k] + 1:
                    j += 1
                out.append((int(path[k]) // 2, start + k, start + j - 1))
        return out

    def viterbi(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """The likeliest states of every chain between two outside tokens; chains of like length are decoded together."""
        out: list = [np.zeros(0, np.int8)] * len(chains)
        order = sorted((i for i in range(len(chains)) if len(chains[i])), key=lambda i: len(chains[i]))
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and (stop + 1 - at) * len(chains[order[stop]]) <= CELLS:
                stop += 1
            group, long = order[at:stop], len(chains[order[stop - 1]])
            sizes = np.array([len(chains[i]) for i in group])
            cells = np.zeros((self.STATES, long, len(group)))
            for k, i in enumerate(group):
                cells[:, : sizes[k], k] = chains[i].T
            back = np.zeros((long, self.STATES, len(group)), np.int8)
            score = cells[:, 0] + self.step[0][:, None]
            for t in range(1, long):
                by = score[:, None] + self.step[:, :, None]
                back[t] = by.argmax(0)
                score = np.where(t < sizes, by.max(0) + cells[:, t], score)
            state = (score + self.step[:, :1]).argmax(0)
            path = np.zeros((long, len(group)), np.int8)
            for t in range(long - 1, -1, -1):
                live = t < sizes
                path[t] = np.where(live, state, 0)
                if t:
                    state = np.where(live, back[t][state, np.arange(len(group))], state)
            for k, i in enumerate(group):
                out[i] = path[: sizes[k], k]
            at = stop
        return out


def _allowed() -> np.ndarray:
    """Inside follows begin or inside of its kind; states are 0, then 2k + 1 (begin) and 2k + 2 (inside)."""
    step = np.zeros((Crf.STATES, Crf.STATES))
    for k in range(len(KINDS)):
        step[:, 2 * k + 2] = -1e4
        step[[2 * k + 1, 2 * k + 2], 2 * k + 2] = 0
    return step


def train(table: list[tuple[str, list[tuple[str, int, int]]]]) -> Crf:
    """Fit to labelled sentences by gradient ascent on the likelihood (forward and backward sums)."""
    tokens = Tokens([text for text, _ in table])
    crf = Crf(np.unique(Crf.codes(tokens.shape)[~tokens.edges]))
    n, s, mask = len(table), Crf.STATES, _allowed()
    crf.step = mask.copy()
    if not n:
        return crf.finish()
    total = len(tokens.shape)
    gold = np.zeros(total, int)
    for i, (_, spans) in enumerate(table):
        for kind, a, b in spans:
            a, b = a + tokens.offsets[i], b + tokens.offsets[i]
            inside = np.flatnonzero((tokens.first >= a) & (tokens.last <= b) & ~tokens.edges)
            gold[inside] = 2 * KINDS.index(kind) + 2
            gold[inside[:1]] = 2 * KINDS.index(kind) + 1
    rows = crf.features(tokens.shape, tokens.gap, np.arange(total))
    rows[tokens.edges] = crf.emit.shape[0] - 1
    used, rows = np.unique(rows, return_inverse=True)
    rows = rows.reshape(total, -1)
    edge = np.where(tokens.edges[:, None] & (np.arange(s) > 0), -60.0, 0.0)  # the edges of a text are outside
    sizes = np.diff(np.append(tokens.begins, total))
    long = int(sizes.max())
    at_t, at_n = ranges(np.zeros(n, np.int64), sizes), np.repeat(np.arange(n), sizes)
    live = np.arange(long)[:, None] < sizes
    # A pair that the table never has in a state speaks against that state, whether it has the pair or not.
    prior, pairs_at = np.zeros_like(crf.emit), slice(3 * SHAPES, 3 * SHAPES + 2 * crf.PAIRS)
    prior[pairs_at, 1:] = UNSEEN
    for column in rows.T[3:5]:
        prior[used[column], gold] = 0
    fixed = prior[used]
    emit, step = np.zeros((len(used), s)), np.zeros((s, s))
    weightless = used == crf.emit.shape[0] - 1

    def summed(values: np.ndarray) -> np.ndarray:
        out = np.zeros_like(emit)
        for column in rows.T:
            np.add.at(out, column, values)
        out[weightless] = 0
        return out

    gold_emit = summed(np.eye(s)[gold])
    follows = at_t[1:] > 0
    gold_step = np.zeros((s, s))
    np.add.at(gold_step, (gold[:-1][follows], gold[1:][follows]), 1)
    moments = [np.zeros_like(x) for x in (emit, step, emit, step)]
    for turn in range(1, ROUNDS + 1):
        table_ = np.zeros((long, n, s))
        table_[at_t, at_n] = (emit + fixed)[rows].sum(1) + edge
        move = np.exp(step + mask)
        weight = np.exp(np.clip(table_, -60, 60))
        forward, backward, scale = np.zeros((long, n, s)), np.ones((long, n, s)), np.ones((long, n))
        for t in range(long):
            forward[t] = np.where(live[t][:, None], (forward[t - 1] @ move) * weight[t], forward[t - 1]) if t else weight[t] * (np.arange(s) == 0)
            scale[t] = forward[t].sum(1)
            forward[t] /= scale[t][:, None]
        pairs = np.zeros((s, s))
        for t in range(long - 2, -1, -1):
            ahead = weight[t + 1] * backward[t + 1] / scale[t + 1][:, None]
            on = live[t + 1][:, None]
            backward[t] = np.where(on, ahead @ move.T, backward[t])
            pairs += move * (forward[t].T @ np.where(on, ahead, 0))
        belief = forward * backward
        belief /= belief.sum(2, keepdims=True)
        expected = summed(belief[at_t, at_n])
        for k, (x, g) in enumerate(((emit, gold_emit - expected - RIDGE * n * emit), (step, gold_step - pairs - RIDGE * n * step))):
            first, second = moments[k], moments[k + 2]
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            x += RATE * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    crf.emit = prior
    crf.emit[used] += emit
    crf.step = step + mask
    return crf.finish()


@lru_cache(maxsize=1)
def default_model() -> Crf:
    return train(labelled_table())


def _groups(texts: list[str]):
    begin = chars = 0
    for i, text in enumerate(texts):
        chars += len(text)
        if chars >= GROUP_CHARS or i == len(texts) - 1:
            yield begin, texts[begin : i + 1]
            begin, chars = i + 1, 0


def find_spans(texts: list[str], model: Crf | None = None) -> list[tuple[dict, list[tuple[str, int, int]]]]:
    """For each text its base spans by kind, and all spans by kind and start."""
    model = model or default_model()
    bases = [base_spans(t) for t in texts]
    added: dict[int, list] = {}
    for begin, group in _groups(texts):
        tokens = Tokens(group)
        for k, i, j in model.decode(tokens):
            nth = int(np.searchsorted(tokens.begins, i, "right")) - 1
            text, base = begin + nth, tokens.offsets[nth]
            kind, a, b = KINDS[k], int(tokens.first[i] - base), int(tokens.last[j] - base)
            if _plausible(kind, texts[text][a:b]) and not any(x < b and a < y for spans in bases[text].values() for x, y in spans):
                added.setdefault(text, []).append((kind, a, b))
    out = []
    for i, base in enumerate(bases):
        spans = [(k, a, b) for k in KINDS for a, b in base[k]] + added.get(i, [])
        out.append((base, sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1]))))
    return out


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span as its kind in brackets; spans that overlap become one."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


def _model(df: DataFrame, model: Crf | None):
    return df.sparkSession.sparkContext.broadcast(model or default_model())


def redact(df: DataFrame, model: Crf | None = None, text: str = "text") -> DataFrame:
    """``df`` with personal data in its text replaced by ``[EMAIL]``, ``[IP]``, ``[CARD]`` or ``[PHONE]``; null stays null."""
    names, at, shared = df.columns, df.columns.index(text), _model(df, model)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = find_spans([t or "" for t in texts], shared.value)
            cols = [*batch.columns]
            cols[at] = pa.array([t and redacted(t, spans) for t, (_, spans) in zip(texts, found)], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(trimmed(run, TEXT_ROWS), df.schema)


def pii_spans(df: DataFrame, model: Crf | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, base spans of each kind, the digest of the base spans, all spans and their number."""
    schema = StructType([StructField(key, df.schema[key].dataType), *(StructField(f"n_{k}", LongType()) for k in KINDS), StructField("base_sha256", StringType()), StructField("spans", StringType()), StructField("n_spans", LongType())])
    shared = _model(df, model)
    joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def run(batches):
        for batch in batches:
            found = find_spans(batch.column(1).to_pylist(), shared.value)
            counts = [pa.array([len(base[k]) for base, _ in found], pa.int64()) for k in KINDS]
            digests = [hashlib.sha256(joined((k, a, b) for k in KINDS for a, b in base[k]).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digests, pa.string()), pa.array([joined(s) for _, s in found], pa.string()), pa.array([len(s) for _, s in found], pa.int64())], names=schema.names)

    return df.select(F.col(key), text_or_empty(text).alias("text")).mapInArrow(trimmed(run, TEXT_ROWS), schema)


def op8_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(documents(spark, sf_dir))
