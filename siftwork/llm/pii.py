"""Personal data by a linear-chain conditional random field.

Features are of a token's shape: its run-length-collapsed and its exact
shape, its ends, the characters it holds, and whether its numbers can be what they look like (check digits of cards and accounts, octets
of addresses). The field is trained by gradient descent on a
small labelled table, anew for every query. Decoding is Viterbi in numpy batches over every token of every text. A token
whose score for "nothing" beats each other label by more than any transitions can
return is certain to be nothing on the best path, so the chain is cut there and
only what lies between such tokens is searched; the result is that of
Viterbi over the whole text.
"""

from __future__ import annotations

import ipaddress
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.hashing import chunks

KINDS = ("EMAIL", "PHONE", "IP", "CARD", "ID")
#: The most rows of a labelled table that a field is trained on, those of the least hash.
TRAIN_ROWS = 5000
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
N = len(LABELS)
SPACE = re.compile(r"\s+")

# A token is split from what is glued to its ends, so that a mark or a quote neither hides nor joins a span.
_CORE = re.compile(r"[^\w+(@]*(.*?)[^\w)]*$", re.S)


def core(token: str) -> tuple[int, int]:
    """Begin and end of the token without the punctuation around it; the whole token where nothing else is left.

    Brackets stay around three digits, as in an area code, and where more follows them.
    """
    m = _CORE.match(token)
    a, b = m.span(1) if m else (0, len(token))
    if token[a : a + 1] == "(":
        close = token.find(")", a, b)
        if close < 0 or (close == b - 1 and not (close - a == 4 and token[a + 1 : close].isdigit())):
            m = _CORE.match(token, a + 1, b if close < 0 else close)
            a, b = m.span(1) if m else (a, b)
    if token[b - 1 : b] == ")" and "(" not in token[a:b]:
        b = a + len(token[a:b].rstrip(")"))
    return (a, b) if b > a else (0, len(token))


# Separators within a token; the brackets of an area code are none.
_INNER = re.compile(r"(?:[,;:=|\"'`/\\<>\[\]{}&?#*!$]|\((?!\d{3}\))|(?<!\(\d{3})\))+")


def pieces(token: str) -> list[str]:
    """The token cut at the separators inside of its core: pieces, with what was between them at the odd places."""
    a, b = core(token)
    if ":" in token and _is_ip6(token[a:b]):
        return [token]
    out, at = [], 0
    for m in _INNER.finditer(token, a, b):
        if a < m.start() and m.end() < b:
            out += [token[at : m.start()], m.group()]
            at = m.end()
    return [*out, token[at:]]


class _Shapes(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = "d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        return out


_SHAPES = _Shapes()


def shape(text: str) -> str:
    """Letters to ``X`` or ``x``, digits to ``d``, all else as it is."""
    return text.translate(_SHAPES)


def collapsed(s: str) -> str:
    return re.sub(r"(.)\1+", r"\1+", s, flags=re.S)


_HEX_COLONS = re.compile(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}")
_ACCOUNT = re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}")


def _is_ip6(text: str) -> bool:
    if not _HEX_COLONS.fullmatch(text):
        return False
    try:
        return ipaddress.IPv6Address(text).packed[:2] != b"\0\0"
    except ValueError:
        return False


def check_digit(digits: str) -> bool:
    """Whether the doubled alternate digits sum up to a multiple of ten."""
    d = [int(c) for c in reversed(digits)]
    return (sum(d[0::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def is_card(digits: str) -> bool:
    """14 to 16 digits of a card issuer whose check digit is right."""
    return 14 <= len(digits) <= 16 and digits[0] in "3456" and digits.isascii() and check_digit(digits)


def checks(text: str) -> tuple[str, ...]:
    """What the digits of a core can be; the same for most tokens of one shape, but not for all."""
    out = []
    digits = re.sub(r"[.-]", "", text)
    if digits.isdigit():
        if is_card(digits):
            out.append("card")
        if digits[0] == "0" and len(digits) > 1:
            out.append("zero")
        quads = text.split(".")
        if len(quads) == 4 and all(q and len(q) <= 3 and int(q) < 256 and (q[0] != "0" or q == "0") for q in quads):
            out.append("quad")
    elif ":" in text and _is_ip6(text):
        out.append("ip6")
    elif _ACCOUNT.fullmatch(text) and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1:
        out.append("account")
    return tuple(out)


def grouped(cores: list[str]) -> list[bool]:
    """Which tokens belong to a card number written in groups of 4, or of 4, 6 and 5 digits."""
    out = [False] * len(cores)
    sizes = [len(c) if c.isdigit() else 0 for c in cores]
    for want in ([4, 4, 4, 4], [4, 6, 5]):
        for i in range(len(cores) - len(want) + 1):
            if sizes[i : i + len(want)] == want and is_card("".join(cores[i : i + len(want)])):
                out[i : i + len(want)] = [True] * len(want)
    return out


def features(token: str, in_group: bool = False) -> list[str]:
    """The features of a token. All come from its shape and its checks, so tokens alike in both score alike."""
    a, b = core(token)
    s = shape(token[a:b])
    c = collapsed(re.sub(r"[Xx]+", "x", s))
    digits = s.count("d")
    at = s.find("@")
    email = 0 < at < len(s) - 3 and s.count("@") == 1 and "." in s[at + 2 :] and not s.endswith(".") and not re.search(r"[^Xxd._%+@-]", s)
    out = ["bias", f"c={c}", f"d={min(digits, 20)}", f"len={min(len(s), 24) // 3}", f"dots={min(s.count('.'), 4)}", f"first={s[:1]}", f"last={s[-1:]}", f"at={s.count('@')}"]
    if digits:
        out += [f"s={s}", *(f"check={x}" for x in checks(token[a:b]))]
    elif ":" in s:
        out += [f"check={x}" for x in checks(token[a:b])]
    if not digits and not at + 1 and ":" not in s:
        # Several features, so that what can't be part of any span soon scores far below nothing.
        out += ["plain", f"plain={c}", f"plain first={s[:1]}", f"plain last={s[-1:]}"]
    if email:
        out.append("mail")
    if "(" in s or ")" in s:
        out.append("paren=" + re.sub("[Xxd]+", "w", s))
    if digits and not any(ch in "Xx" for ch in s):
        out.append(f"numeric={digits}:{s.count('-')}")
    if in_group:
        out.append("group")
    return out


def labelled_rows(seed: int = 5, n: int = 900) -> list[tuple[list[str], list[str]]]:
    """The labelled table: tokens (as ``pieces`` cuts them) and labels of short made sentences, with look-alikes that are no personal data."""
    r = random.Random(seed)
    low = "abcdefghijklmnopqrstuvwxyz"

    def word(letters: str = low + "éèöüñóßçàø", sizes: tuple[int, ...] = (1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 13, 16, 20, 26)) -> str:
        w = "".join(r.choice(letters) for _ in range(r.choice(sizes)))
        return r.choice([w, w, w, w.capitalize(), w.upper()])

    def digits(*sizes: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(r.choice(sizes)))

    def glue() -> str:
        return r.choice(["", "", "", "", ",", ".", "!!", "?", ")", ";", "..."])

    def email() -> list[str]:
        def name() -> str:
            return word(low, (1, 2, 3, 4, 5, 6, 8, 10)).lower() + r.choice(["", "", "", digits(1, 2, 3)])

        user = r.choice(["", "", digits(2, 3)]) + r.choice([".", "_", "-", "+", ""]).join(name() for _ in range(r.choice([1, 1, 2, 3])))
        if r.random() < 0.15:
            user = user.upper()
        host = ".".join([r.choice(["", "", "", word(low, (1, 3, 5)).lower() + "-"]) + name() for _ in range(r.choice([1, 1, 2, 3]))])
        return [r.choice(["", "", "", "<", "("]) + f"{user.strip('._+-') or 'a'}@{host}.{word(low, (2, 2, 3, 3, 4, 6)).lower()}" + r.choice([glue(), ">"])]

    def phone() -> list[str]:
        a, b, c, k = digits(3), digits(3), digits(4), r.choice("123456789") + digits(0, 1)
        t = r.choice(
            [
                [f"+{k}", f"({a})", f"{b}-{c}"], [f"+{k}", f"({a})", f"{b}-{c}"], [f"+{k}", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"+{k}-{a}-{b}-{c}"], [f"+{k}", a, b, c], [f"{a}.{b}.{c}"], [f"+{k}{digits(8, 9, 10)}"],
                [f"0{digits(2)}", c, digits(4)], [f"0{digits(2)}", c, digits(4)], [f"0{digits(2)}", c, digits(4)], [f"(0{digits(2)})", c, digits(4)], [f"0{digits(4)}", digits(6)], [f"0{digits(3)}", digits(6, 7)], [f"0{digits(2)}", digits(7, 8)], [f"+{k}", digits(2), c, digits(4)], [f"+{k}", digits(4), digits(6)],
                [f"+{k}", digits(2, 3), digits(6, 7, 8)], [f"+{k}", digits(1), digits(2), digits(2), digits(2), digits(2)], [f"0{digits(1)}", *(r.choice("123456789") + digits(1) for _ in range(4))],
            ]
        )
        return [*t[:-1], t[-1] + glue()]

    def octets() -> str:
        return ".".join(str(r.choice([r.randint(0, 9), r.randint(0, 255), r.randint(0, 255)])) for _ in range(4))

    def address() -> list[str]:
        if r.random() < 0.8:
            return [octets() + glue()]
        full = [f"{r.randint(1, 65535):x}" for _ in range(8)]
        return [r.choice([":".join(full), ":".join(x.zfill(4) for x in full), f"{full[0]}::{full[1]}", f"{full[0]}:{full[1]}:{full[2]}::{full[3]}"])]

    def number(size: int, lead: str, valid: bool) -> str:
        while True:
            d = r.choice(lead) + digits(size - 1)
            if check_digit(d) == valid:
                return d

    def in_groups(d: str, mark: str) -> list[str]:
        parts = [d[:4], d[4:10], d[10:]] if len(d) == 15 else [d[i : i + 4] for i in range(0, len(d), 4)]
        return mark.join(parts).split(" ")

    def card() -> list[str]:
        d = number(r.choice([16, 16, 16, 15, 14]), "3456", True)
        t = [d] if r.random() < 0.6 or len(d) == 14 else in_groups(d, r.choice([" ", "-"]))
        return [*t[:-1], t[-1] + glue()]

    def no_card() -> list[str]:
        size = r.choice([16, 16, 16, 15, 14])
        d = r.choice([number(size, "3456", False), digits(13, 17, 18), number(size, "012789", True), number(size, "012789", False)])
        return [d + glue()] if r.random() < 0.6 or len(d) not in (15, 16) else in_groups(d, r.choice([" ", "-"]))

    def official() -> list[str]:
        if r.random() < 0.5:
            return [f"{digits(3)}-{digits(2)}-{digits(4)}" + glue()]
        while True:
            land, rest = word("ABCDEFGHIJKLMNOPQRSTUVWXYZ", (2,)).upper(), r.choice(["", word("ABCDEFGHIJKLMNOPQRSTUVWXYZ", (4,)).upper()]) + digits(12, 14, 18)
            check = 98 - int("".join(str(int(c, 36)) for c in rest + land + "00")) % 97
            return [f"{land}{check:02d}{rest}" + glue()]

    def other() -> list[str]:
        hex_ = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 12, 16, 18, 32, 40, 64])))
        return r.choice(
            [
                [digits(1, 2, 3, 4, 5, 6, 7, 8, 9, 10) + glue()], [digits(1, 2, 3, 4, 5, 6, 7, 8) + glue()], [f"{digits(1)}.{digits(1, 2)}.{digits(1)}"], [f"{digits(1, 2, 3)}.{digits(1, 2, 3)}"], [f"{digits(4)}-{digits(2)}-{digits(2)}"], [f"{digits(2)}:{digits(2)}"], [f"{digits(2)}:{digits(2)}:{digits(2)}"],
                [f"v{digits(1)}.{digits(1)}"], [f"{digits(1, 2)}.{digits(1)}.{digits(4, 5)}.{digits(4, 5)}"], [".".join(r.sample([str(r.randint(256, 999)), *(str(r.randint(0, 300)) for _ in range(3))], 4))], [f"{digits(3)}-{digits(4)}-{digits(2)}"], [f"{digits(2, 3)}-{digits(1)}-{digits(2, 3)}-{digits(6)}-{digits(1)}"], [f"#{digits(4)}"], [f"({digits(1, 3, 4)})"], [f"@{word()}"], [f"{digits(4)}-{digits(4)}"], [f"{digits(3)}-{digits(4)}"], [f"x{digits(20)}"], [digits(20, 24, 30)],
                [hex_], [f'"{hex_}"'], ["AKIA" + word("ABCDEFGHJKMNPQRSTVWXYZ234567", (16,)).upper()], [word("abcdef0123456789", (4,)).lower() + "-" + hex_[:4]], ["|"], ["="], ["CC"], ["BY-NC"], [f"{digits(1)}.0."], ["(c)"], ["***"], [f"{word()}@"], [f"{word()}@{word()}"], [f"+{digits(1, 2)}"], [f"{digits(3)}%"], [f"{digits(2)}.{digits(2)}.{digits(4)}"], [f"{digits(3)}-{digits(2)}"],
                [r.choice("123456789") + digits(2), digits(4)], [digits(2), digits(2), digits(2)], [r.choice("123456789") + digits(2, 3) for _ in range(r.randint(2, 6))], [r.choice("123456789") + digits(2, 3) for _ in range(r.randint(2, 6))], [f"0{i}" for i in range(r.randint(1, 3), r.randint(4, 7))], [f"0.{digits(1, 2, 3)}"], [f"0{digits(1, 2)}"], [f"{digits(2)}-{digits(7)}"], [f"{word('ABCDEFGHIJ', (2,)).upper()}{digits(2, 6, 10, 14)}"], [f"{word('ABCDEFGHIJ', (2,)).upper()}{digits(14, 16, 20)}"], [f"{word('ABCDEFGHIJ', (2,)).upper()}{digits(2)}{word('KLMNOPQRS', (4,)).upper()}{digits(14, 18)}"], [digits(4), digits(4)],
            ]
        )

    def between() -> str:
        return r.choice([",", ";", ":", "|", '":"', '","', "=", "/", "&", ">,<"])

    makers = {"EMAIL": email, "PHONE": phone, "IP": address, "CARD": card, "ID": official}
    rows = []
    for i in range(n):
        toks: list[str] = []
        labs: list[str] = []
        glued = i % 4 == 0
        for _ in range(r.randint(2, 6)):
            for _ in range(r.choice([0, 0, 1]) if glued else r.randint(0, 4)):
                toks.append(word() + ("" if glued else glue()))
                labs.append("O")
                if glued:
                    toks.append(between())
                    labs.append("O")
            pick = r.choice([*KINDS, "OTHER", "OTHER", "OTHER", "CARDLESS", "WORDS"])
            t = makers[pick]() if pick in makers else other() if pick == "OTHER" else no_card() if pick == "CARDLESS" else [word()]
            toks += t
            labs += [f"B-{pick}", *[f"I-{pick}"] * (len(t) - 1)] if pick in makers else ["O"] * len(t)
            if glued:
                toks.append(between())
                labs.append("O")
        rows.append((toks, labs))
    return rows


def labelled_table(spark: SparkSession, seed: int = 5, n: int = 900) -> DataFrame:
    """``tokens`` and ``labels`` of ``labelled_rows``."""
    return spark.createDataFrame(labelled_rows(seed, n), "tokens array<string>, labels array<string>")


class Field:
    """A trained chain: weights of features by label, transitions, starts."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, trans: np.ndarray, start: np.ndarray):
        self.index, self.emit, self.trans, self.start = index, emit, trans, start
        back = trans[:, :, None] + trans[None, :, :]  # from a, by l, to b
        gain = (back.transpose(1, 0, 2) - back[:, 0, :][None]).reshape(N, -1).max(axis=1)
        first = ((start[:, None] + trans) - (start[0] + trans[0])[None]).max(axis=1)
        ends = (trans.T - trans[:, 0][None]).max(axis=1)
        alone = start - start[0]
        #: By label, the most that choosing it over "O" can gain from the token's neighbours.
        self.margin = np.maximum.reduce([gain, first, ends, alone])

    def score(self, token: str, in_group: bool = False) -> tuple[np.ndarray, bool]:
        """The token's score by label, and whether it is certain to be "O"."""
        ids = [i for f in features(token, in_group) if (i := self.index.get(f)) is not None]
        e = self.emit[ids].sum(axis=0)
        return e, bool(((e[0] - e)[1:] > self.margin[1:] + 1e-9).all())

    def viterbi(self, scores: list[np.ndarray]) -> list[list[int]]:
        """Best label paths of sequences given as (length, label) arrays, as one batch per length."""
        out: list[list[int]] = [[] for _ in scores]
        by: dict[int, list[int]] = {}
        for i, s in enumerate(scores):
            by.setdefault(len(s), []).append(i)
        for length, which in by.items():
            if not length:
                continue
            x = np.stack([scores[i] for i in which])
            v, back = self.start + x[:, 0], []
            for t in range(1, length):
                w = v[:, :, None] + self.trans
                back.append(w.argmax(axis=1))
                v = w.max(axis=1) + x[:, t]
            path = [v.argmax(axis=1)]
            for p in reversed(back):
                path.append(p[np.arange(len(which)), path[-1]])
            for i, labels in zip(which, np.stack(path[::-1], axis=1).tolist(), strict=True):
                out[i] = labels
        return out


def train(rows: list[tuple[list[str], list[str]]], steps: int = 140, rate: float = 0.12, decay: float = 1e-4) -> Field:
    """Maximise the conditional likelihood of the labelled rows with Adam over the padded batch.

    Forward and backward sums are kept as probabilities and scaled at each place.
    """
    number = {x: i for i, x in enumerate(LABELS)}
    rows = [x for x in rows if x[0]]
    if not rows:
        return Field({}, np.zeros((1, N)), np.zeros((N, N)), np.zeros(N))
    index: dict[str, int] = {}
    # Tokens that are alike share one row of scores.
    kinds: dict[tuple[int, ...], int] = {}
    b, length = len(rows), max(len(x) for x, _ in rows)
    of = np.zeros((b, length), np.int64)
    gold = np.zeros((b, length), np.int64)
    real = np.zeros((b, length), bool)
    for i, (toks, labs) in enumerate(rows):
        together = grouped([t[slice(*core(t))] for t in toks])
        for j, (t, lab) in enumerate(zip(toks, labs, strict=True)):
            ids = tuple(index.setdefault(f, len(index)) for f in features(t, together[j]))
            of[i, j], gold[i, j], real[i, j] = kinds.setdefault(ids, len(kinds)), number[lab], True
    flat = np.concatenate([np.array(k) for k in kinds])
    width = np.array([len(k) for k in kinds])
    begin = np.cumsum(width) - width
    places, owner = of[real], np.repeat(np.arange(len(kinds)), width)
    params = [np.zeros((len(index), N)), np.zeros((N, N)), np.zeros(N)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    eye = np.eye(N)
    both = real[:, 1:] & real[:, :-1]
    seen = np.einsum("bti,btj->ij", eye[gold[:, :-1]] * both[..., None], eye[gold[:, 1:]])
    for step in range(1, steps + 1):
        emit, trans, start = params
        e = np.add.reduceat(emit[flat], begin, axis=0)[of]
        e = np.where(real[..., None], np.exp(e - e.max(axis=2, keepdims=True)), 1.0)
        go = np.exp(trans)
        alpha, beta, scale = np.empty((b, length, N)), np.ones((b, length, N)), np.ones((b, length))
        now = np.exp(start - start.max()) * e[:, 0]
        alpha[:, 0] = now / now.sum(axis=1, keepdims=True)
        for t in range(1, length):
            now = (alpha[:, t - 1] @ go) * e[:, t]
            scale[:, t] = np.where(real[:, t], now.sum(axis=1), 1.0)
            alpha[:, t] = np.where(real[:, t, None], now / scale[:, t, None], alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            back = ((e[:, t + 1] * beta[:, t + 1]) @ go.T) / scale[:, t + 1, None]
            beta[:, t] = np.where(real[:, t + 1, None], back, 1.0)
        prob = alpha * beta
        prob = prob / prob.sum(axis=2, keepdims=True) * real[..., None]
        d_e = (eye[gold] * real[..., None] - prob) / b
        by_kind = np.stack([np.bincount(places, d_e[..., k][real], len(kinds)) for k in range(N)], axis=1)
        g_emit = np.stack([np.bincount(flat, by_kind[owner, k], len(index)) for k in range(N)], axis=1)
        right = e[:, 1:] * beta[:, 1:] / scale[:, 1:, None] * both[..., None]
        pair = go * np.einsum("bti,btj->ij", alpha[:, :-1], right, optimize=True)
        grads = [g_emit - decay * emit, (seen - pair) / b - decay * trans, d_e[:, 0].sum(axis=0) - decay * start]
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            params[i] = params[i] + rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return Field(index, *params)


def fit(labelled: DataFrame, most: int = TRAIN_ROWS) -> Field:
    """A field trained on a table with ``tokens`` and ``labels`` (arrays of one length, the labels of LABELS), at most ``most`` rows of it, those of the least hash.

    Rows with a null or of unequal lengths are left out; repeated rows count as often as they occur. Without any, everything is "O".
    """
    t = labelled.select(F.col("tokens").cast("array<string>").alias("tokens"), F.col("labels").cast("array<string>").alias("labels"))
    t = t.filter((F.size("tokens") == F.size("labels")) & (F.size("tokens") > 0) & F.forall("tokens", lambda x: x.isNotNull()) & F.forall("labels", lambda x: x.isin(*LABELS)))
    rows = t.orderBy(F.xxhash64("tokens", "labels"), "tokens", "labels").limit(most).collect()
    return train([(r["tokens"], r["labels"]) for r in rows])


def default_field(seed: int = 5) -> Field:
    return train(labelled_rows(seed))


class _Memo(dict):
    """Scores by token, emptied when it has grown."""

    def __init__(self, field: Field, most: int = 150_000):
        super().__init__()
        self.field, self.most = field, most
        self.shapes: dict[str | tuple, np.ndarray | None] = {}
        self.cut: dict[str, list[str]] = {}
        #: Tokens of one piece that are certain to be nothing.
        self.nothing: set[str] = set()

    def pieces(self, token: str) -> list[str]:
        if token.isalnum() or (token[:-1].isalnum() and token[-1] in ".,;:!?"):
            return [token]
        if (out := self.cut.get(token)) is None:
            out = pieces(token)
            if len(self.cut) >= self.most:
                self.cut.clear()
            if len(token) <= 64:
                self.cut[token] = out
        return out

    def __missing__(self, token: str):
        s = shape(token)
        k, c = s, ""
        if "d" in s or ":" in s:
            c = token[slice(*core(token))]
            k = (s, checks(c))
        if k in self.shapes:
            out = self.shapes[k]
        else:
            e, certain = self.field.score(token)
            if len(self.shapes) >= self.most:
                self.shapes.clear()
            # What may be a group of a card number depends on its neighbours.
            self.shapes[k] = out = None if certain and not (4 <= len(c) <= 6 and c.isdigit()) else e
        if len(self) >= self.most:
            self.clear()
        if len(token) <= 64:
            self[token] = out
        return out


def spans(field: Field, texts: list[str], memo: _Memo | None = None) -> list[list[tuple[int, int, str]]]:
    """Begin, end (in characters) and kind of each span of personal data, by text.

    What separators join without blanks is cut there; a separator is nothing for certain, so no span goes over it.
    """
    memo = _Memo(field) if memo is None else memo
    nothing = memo.nothing
    runs: list[tuple[int, list[int]]] = []
    seqs: list[np.ndarray] = []
    tokens: list[list[str]] = []
    for i, text in enumerate(texts):
        toks, got = [], []
        for token in text.split():
            if token in nothing:
                toks.append(token)
                got.append(None)
                continue
            cut = memo.pieces(token)
            for k, piece in enumerate(cut):
                toks.append(piece)
                got.append(None if k % 2 else memo[piece])
            if len(cut) == 1 and got[-1] is None and len(token) <= 64:
                if len(nothing) >= memo.most:
                    nothing.clear()
                nothing.add(token)
        tokens.append(toks)
        at = [k for k, s in enumerate(got) if s is not None]
        if not at:
            continue
        run = [at[0]]
        for k in at[1:]:
            if k == run[-1] + 1:
                run.append(k)
            else:
                runs.append((i, run))
                run = [k]
        runs.append((i, run))
        while len(seqs) < len(runs):
            run = runs[len(seqs)][1]
            together = grouped([toks[q][slice(*core(toks[q]))] for q in run]) if len(run) > 2 else ()
            seqs.append(np.stack([field.score(toks[q], True)[0] if together and together[j] else got[q] for j, q in enumerate(run)]))
    paths = _decode(field, runs, seqs, [len(t) for t in tokens])
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    hits: dict[int, list[tuple[int, int]]] = {}
    for (i, run), labels in zip(runs, paths, strict=True):
        if any(labels):
            hits.setdefault(i, []).extend(zip(run, labels, strict=True))
    for i, marks in hits.items():
        starts = _offsets(texts[i], tokens[i])
        last = -2
        for k, label in marks:
            if not label:
                continue
            tag, kind = LABELS[label].split("-")
            a, b = core(tokens[i][k])
            a, b = starts[k] + a, starts[k] + b
            if tag == "I" and last == k - 1 and out[i] and out[i][-1][2] == kind:
                out[i][-1] = (out[i][-1][0], b, kind)
            else:
                out[i].append((a, b, kind))
            last = k
    return out


def _decode(field: Field, runs, seqs: list[np.ndarray], lengths: list[int]) -> list[list[int]]:
    """Viterbi over each run, with the certain "O" on either side of it."""
    padded = []
    for (i, run), s in zip(runs, seqs, strict=True):
        s = s.copy()
        if run[0]:
            s[0] += field.trans[0] - field.start
        if run[-1] < lengths[i] - 1:
            s[-1] += field.trans[:, 0]
        padded.append(s)
    return field.viterbi(padded)


def _offsets(text: str, toks: list[str]) -> list[int]:
    out, at = [], 0
    for t in toks:
        at = text.index(t, at)
        out.append(at)
        at += len(t)
    return out


_SPAN = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())])


def _in_chunks(field: Field, texts: list[str], memo: _Memo) -> list[list[tuple[int, int, str]]]:
    """``spans`` of about a million characters at a time, as their tokens take many times the room of the texts."""
    return [x for a, b in chunks(map(len, texts), 1 << 20) for x in spans(field, texts[a:b], memo)]


def _find(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(field)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = _in_chunks(field, texts, memo)
            rows = [[{"begin": a, "end": b, "kind": k, "value": t[a:b]} for a, b, k in s] for t, s in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(_SPAN))], names=["id", "spans"])

    return run


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for a, b, kind in found:
        parts += [text[at:a], f"<{kind}>"]
        at = b
    return "".join([*parts, text[at:]]) if found else text


def find(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``begin``, ``end`` (characters from 0, end exclusive), ``kind``, ``value``: one row per span.

    Null and empty texts have no spans. Repeated rows give their spans each time, ids may be null, texts of any
    length are searched whole, other columns are ignored, and an empty table gives an empty result. Spans of a text never overlap; where two labellings
    score the same, the label that comes first in LABELS wins.
    """
    field = field or default_field()
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    got = src.mapInArrow(_find(field), f"id {kind}, spans array<struct<begin:int,end:int,kind:string,value:string>>")
    return got.select("id", F.explode("spans").alias("s")).select("id", "s.*")


def redacted(docs: DataFrame, field: Field | None = None, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in angle brackets.

    A size column, where there is one, is set to the new length. All other columns, of any name and type, stay. Null texts stay null.
    """
    field = field or default_field()
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(field)
        for batch in batches:
            # A megabyte of texts at a time is read, searched and passed on; what is held of the whole batch is what came in.
            for a, b in chunks(pc.binary_length(batch.column(at).cast(pa.string())).to_pylist(), 1 << 20):
                part = batch.slice(a, b - a)
                texts = part.column(at).to_pylist()
                found = spans(field, [t or "" for t in texts], memo)
                clean = [None if t is None else redact(t, s) for t, s in zip(texts, found, strict=True)]
                cols = list(part.columns)
                cols[at] = pa.array(clean, cols[at].type)
                yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    if size_col and size_col in docs.columns:
        out = out.withColumn(size_col, F.when(F.col(text_col).isNull(), F.col(size_col)).otherwise(F.length(text_col)).cast(docs.schema[size_col].dataType))
    return out
