"""Secret scans: a linear-chain conditional random field over the words of a text, decoded by Viterbi."""

from __future__ import annotations

import random
import string
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from postlane.llm.common import blocks, texts_of
from postlane.llm.words import NOT_SPACE, lower, spans

#: Tags: outside, begin, inside.
O, B, I = 0, 1, 2
#: Lines made up for training; they and the weights depend on nothing but the seed.
LINES, SEED = 3000, 11
MASK = "[SECRET]"
#: Bytes of texts whose features are made at a time: they take about a hundred times the room.
_PIECE = 256 << 10

_KIND = np.zeros(256, np.uint8)  # 1 lower, 2 capital, 3 digit, 4 anything else but bytes beyond ASCII
_KIND[:128] = 4
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdefABCDEF"]] = True
_QUOTE = np.zeros(256, bool)
_QUOTE[[*b"\"'`"]] = True
_EDGE = np.zeros(256, bool)
_EDGE[[*b"\"'`,;.!?()[]{}<>*#$%&|"]] = True
_CODE = np.zeros(256, bool)
_CODE[[*b"={}[]();\"_<>"]] = True
_ASSIGN = np.zeros(256, bool)
_ASSIGN[[*b"=:"]] = True

_STEMS = ("toke", "secr", "pass", "pwd", "apik", "api_", "api-", "_key", "-key", "cred", "bear", "auth")
_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "gith", "sk-", "sk_l", "xoxb", "xoxp", "eyJ", "AIza", "glpa", "ya29", "SG.", "----", "http", "post", "mysq", "MII")
SIZES = (160, 60, len(_PREFIXES) + 1, len(_PREFIXES) + 1, 8, 4, 16, 10, 16, 120, 8)


def _code(stem: str) -> tuple[int, int]:
    raw = stem.encode()
    return int.from_bytes(raw, "little"), (1 << (8 * len(raw))) - 1


def encode(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(codes: n words x features, start, end, core start, core end, text number) of a block of texts.

    Features are of the word's shape (length, kinds of characters, digits, changes of kind, known prefixes, quotes,
    assignment), of its neighbours (words that announce a secret one and two before, assignment before, kind of the
    next) and of the file (how many words announce a secret, how much of it reads like code).
    """
    starts, ends, of = spans(raw, offsets, NOT_SPACE)
    n = len(starts)
    if not n:
        return np.zeros((0, len(SIZES)), np.int16), starts, ends, starts, ends, of
    cs, ce = starts.copy(), ends.copy()
    for _ in range(2):
        cs += _EDGE[raw[cs]] & (cs + 1 < ce)
    for _ in range(4):
        ce -= _EDGE[raw[ce - 1]] & (cs + 1 < ce)

    def total(mask: np.ndarray) -> np.ndarray:
        out = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=out[1:])
        return out

    kind = _KIND[raw]
    size = (ce - cs).astype(np.int32)
    low_n, up_n, dig_n, odd_n = (t[ce] - t[cs] for t in (total(kind == k) for k in (1, 2, 3, 4)))
    change = np.zeros(len(raw), bool)
    change[1:] = kind[1:] != kind[:-1]
    t = total(change)
    turns = t[ce] - t[np.minimum(cs + 1, ce)]
    t = total(_HEX[raw])
    hexa = (t[ce] - t[cs] == size) & (size >= 16)

    low = lower(raw)
    four = np.zeros(len(raw), np.uint32)
    for k in range(4):
        four[: len(raw) - k] |= low[k:].astype(np.uint32) << np.uint32(8 * k)
    hit = np.zeros(len(raw), bool)
    for stem in _STEMS:
        value, mask = _code(stem)
        hit |= (four & np.uint32(mask) if mask != 0xFFFFFFFF else four) == np.uint32(value)
    t = total(hit)
    keyword = t[ends] - t[starts] > 0
    head = np.zeros(n, np.uint32)
    for k in range(4):
        at = cs + k
        head |= np.where(at < ce, raw[np.minimum(at, len(raw) - 1)], 0).astype(np.uint32) << np.uint32(8 * k)
    prefix = np.zeros(n, np.int16)
    for k, stem in enumerate(_PREFIXES):
        value, mask = _code(stem)
        prefix[(head & np.uint32(mask)) == np.uint32(value)] = k + 1

    t = total(_ASSIGN[raw])
    assigns = t[ends] - t[starts]
    last = _ASSIGN[raw[ce - 1]]
    quoted = _QUOTE[raw[starts]]
    same = np.zeros(n, bool)
    same[1:] = of[1:] == of[:-1]

    def before(x: np.ndarray, k: int = 1) -> np.ndarray:
        out = np.zeros_like(x)
        if n > k:
            out[k:] = x[:-k] * (of[k:] == of[:-k])
        return out

    bucket = np.searchsorted(np.array([4, 8, 12, 16, 20, 32, 40, 41, 64]), size, "right")
    mixture = (dig_n > 0) + 2 * (up_n > 0) + 4 * (low_n > 0) + 8 * (odd_n > 0)
    digits = np.minimum(5 * dig_n // np.maximum(size, 1), 4)
    random_like = np.searchsorted(np.array([2, 4, 8, 14, 22]), turns, "right")
    following = np.zeros(n, np.int64)
    following[:-1] = np.where(of[1:] == of[:-1], 1 + (dig_n[1:] > 0) + 2 * (odd_n[1:] > 0), 0)
    texts = len(offsets) - 1
    announced = np.bincount(of, keyword, minlength=texts)
    t = total(_CODE[raw])
    code = (t[offsets[1:]] - t[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)
    file = (np.searchsorted(np.array([1, 2, 4]), announced, "right") * 4 + np.searchsorted(np.array([0.001, 0.01, 0.03]), code, "right"))[of]
    b1, b2 = before(keyword), before(keyword, 2)
    a1 = before(assigns > 0)
    near = (b1 | b2) & a1 | keyword & (assigns > 0)
    columns = (
        bucket * 16 + mixture,
        digits * 12 + hexa * 6 + random_like,
        prefix,
        before(prefix),
        keyword + 2 * b1 + 4 * b2,
        (assigns > 0) + 2 * last,
        a1 + 2 * quoted + 4 * _QUOTE[raw[np.minimum(ce, len(raw) - 1)]] + 8 * before(last),
        following * 2 + (~same),
        file,
        near * 60 + bucket * 6 + random_like,
        (dig_n == size) + 2 * (near & (size >= 6)) + 4 * (prefix > 0),
    )
    return np.stack(columns, axis=1).astype(np.int16), starts, ends, cs, ce, of


class Field:
    """Weights of each feature's values and of each pair of neighbouring tags."""

    def __init__(self, emission: list[np.ndarray], transition: np.ndarray) -> None:
        self.emission, self.transition = emission, transition

    def scores(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), 3), np.float32)
        for k, table in enumerate(self.emission):
            out += table[codes[:, k]]
        return out

    def decode(self, codes: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The best tags of each text's words, the word before the first and after the last counting as outside.

        Against a path that is outside throughout, a run of other tags gains at most the sum over its words of what
        the better of both tags gains there, each with the best transition into it. A word is outside on every best
        path if no run over it can gain, so the chain is cut there and Viterbi runs on what lies between: the result
        is that of the whole chain.
        """
        s, t = self.scores(codes), self.transition
        tags = np.zeros(len(s), np.int8)
        into = (t - t[O, O]).max(axis=0)
        u = np.maximum(s[:, B] - s[:, O] + into[B], s[:, I] - s[:, O] + into[I]).astype(np.float64)
        apart = 1 + np.maximum(u, 0).sum()  # no run pays beyond its text
        total = np.cumsum(u - apart * (np.diff(of, prepend=of[:1]) > 0))
        most = np.maximum.accumulate(total[::-1])[::-1] - np.minimum.accumulate(total - u)
        open_ = np.flatnonzero(most + max(0, (t[:, O] - t[O, O]).max()) > -1e-3)
        if not len(open_):
            return tags
        first = np.flatnonzero(np.r_[True, (np.diff(open_) > 1) | (of[open_[1:]] != of[open_[:-1]])])
        start, size = open_[first], np.diff(np.r_[first, len(open_)])
        for group in np.split(np.argsort(size, kind="stable"), np.flatnonzero(np.diff(np.sort(size))) + 1):
            m, at = int(size[group[0]]), start[group]
            best = t[O] + s[at]
            back = np.zeros((m, len(group), 3), np.int8)
            for j in range(1, m):
                step = best[:, :, None] + t[None]
                back[j] = step.argmax(axis=1)
                best = step.max(axis=1) + s[at + j]
            y = (best + t[:, O]).argmax(axis=1)
            for j in range(m - 1, -1, -1):
                tags[at + j] = y
                y = back[j][np.arange(len(group)), y]
        return tags


def _word(r: random.Random) -> str:
    return "".join(r.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "le", "ou", "ché", "ung", "ción", "para", "der", "a")) for _ in range(r.randint(1, 4)))


def _secret(r: random.Random) -> list[str]:
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    alnum = string.ascii_letters + string.digits
    kind = r.randrange(12)
    if kind < 4:
        return [pick("0123456789abcdef", r.choice((32, 40, 40, 64)))]
    if kind == 4:
        return [pick(alnum + "+/", r.randint(24, 64)) + r.choice(("", "=", "=="))]
    if kind == 5:
        return [r.choice(("AKIA", "ASIA")) + pick(string.ascii_uppercase + string.digits, 16)]
    if kind == 6:
        return [r.choice(("ghp_", "gho_", "github_pat_", "glpat-")) + pick(alnum, 36)]
    if kind == 7:
        return [r.choice(("sk_live_", "sk-", "xoxb-", "xoxp-", "AIza", "ya29.", "SG.")) + pick(alnum + "-_", r.randint(24, 40))]
    if kind == 8:
        return ["eyJ" + pick(alnum, 20) + ".eyJ" + pick(alnum, 30) + "." + pick(alnum + "-_", 40)]
    if kind == 9:
        return [pick(alnum + "!@#%^*_-", r.randint(8, 16)) + r.choice("0123456789")]
    if kind == 10:
        return ["-----BEGIN", r.choice(("RSA", "EC")), "PRIVATE", "KEY-----", *(("MII" if k == 0 else "") + pick(alnum + "+/", 60) for k in range(r.randint(2, 6))), "-----END", "RSA", "PRIVATE", "KEY-----"]
    return [pick(alnum, r.randint(20, 44))]


def _line(r: random.Random) -> list[tuple[str, int]]:
    """Words with tags: prose, in it perhaps a secret or something that only looks like one, perhaps of junk style."""
    out = [(_word(r), O) for _ in range(r.randint(0, 25))]
    for _ in range(r.choice((0, 1, 1, 2))):
        if r.random() < 0.55:
            words = _secret(r)
            name = r.choice(("token", "secret", "password", "api_key", "apikey", "auth_token", "SECRET_KEY", "access_token", "client_secret", "passwd", "pwd", "credential"))
            name = r.choice((name, name, name.upper(), name.title()))
            quote = r.choice(('"', '"', "'", ""))
            bare = words[0][:4] in ("AKIA", "ASIA", "ghp_", "gho_", "gith", "glpa", "sk_l", "xoxb", "xoxp", "AIza") or words[0][:3] == "eyJ"
            if len(words) > 1:
                out += [(w, B if k == 0 else I) for k, w in enumerate(words)]
            elif bare and r.random() < 0.3:
                out.append((words[0], B))
            else:
                value = quote + words[0] + quote + r.choice(("", "", ",", ";", "."))
                form = r.randrange(5)
                if form == 0:
                    out.append((f"{name}={value}", B))
                elif form == 1:
                    out += [(f"{name}:", O), (value, B)]
                elif form == 2:
                    out += [(f'"{name}":', O), (value, B)]
                elif form == 3 and name.lower().startswith("auth"):
                    out += [("Authorization:", O), ("Bearer", O), (value, B)]
                else:
                    out += [(name, O), ("=", O), (value, B)]
        else:
            digits = lambda n: "".join(r.choice(string.digits) for _ in range(n))
            hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
            plain = [
                ["+1", f"({digits(3)})", f"555-{digits(4)}"],
                [digits(16)],
                [".".join(digits(2) for _ in range(4))],
                [f"{_word(r)}.{digits(2)}@mail{digits(1)}.example.com"],
                [f"https://{_word(r)}.example.com/{_word(r)}?page={digits(2)}&ref=x"],
                ["commit", hexa(40)],
                ["sha256:", hexa(64)],
                ["id", "=", "-".join(hexa(n) for n in (8, 4, 4, 4, 12))],
                ["the", "token", "of", _word(r)],
                ["password", "is", "needed"],
                ["key", "=", digits(2)],
                ["Version", "2.0."],
                ["token", "=", _word(r)],
                [f"{digits(4)}-{digits(2)}-{digits(2)}"],
                ["x", "=", digits(3) + ";"],
                ["All", "rights", "reserved."],
                [_word(r).upper() + "!!"],
                ["|", _word(r), "|"],
            ]
            out += [(w, O) for w in r.choice(plain)]
        out += [(_word(r) + r.choice(("", "", ",", ".")), O) for _ in range(r.randint(0, 12))]
    style = r.randrange(8)
    if style == 0:
        out = [(w + r.choice(("***", "###", "%%%", "&&&", "$$$")), y) for w, y in out]
    elif style == 1:
        out = [(w.upper() + "!!", y) for w, y in out]
    elif style == 2:
        out = [x for w, y in out for x in ((w, y), ("|", I if y == I else O))]
    return out or [("a", O)]


def _forward_backward(s: np.ndarray, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tag probabilities, expected transitions) of padded sequences of n words each."""
    lse = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    count, width, _ = s.shape
    alpha, beta = np.zeros_like(s), np.zeros_like(s)
    alpha[:, 0] = t[O] + s[:, 0]
    for j in range(1, width):
        alpha[:, j] = lse(alpha[:, j - 1][:, :, None] + t[None], 1) + s[:, j]
    rows = np.arange(count)
    for j in range(width - 1, -1, -1):
        nxt = lse(t[None] + (s[:, j + 1] + beta[:, j + 1])[:, None, :], 2) if j + 1 < width else np.zeros((count, 3))
        beta[:, j] = np.where((n - 1 == j)[:, None], t[:, O][None], nxt)
    z = lse(alpha[rows, n - 1] + t[:, O], 1)
    inside = np.arange(width)[None] < n[:, None]
    p = np.exp(np.where(inside[..., None], alpha + beta - z[:, None, None], -np.inf))
    pair = np.zeros((3, 3))
    for j in range(width - 1):
        on = n > j + 1
        pair += np.exp(alpha[on, j][:, :, None] + t[None] + (s[on, j + 1] + beta[on, j + 1])[:, None, :] - z[on][:, None, None]).sum(axis=0)
    pair[O] += p[:, 0].sum(axis=0)
    pair[:, O] += p[rows, n - 1].sum(axis=0)
    return p, pair


@cache
def train(lines: int = LINES, seed: int = SEED, epochs: int = 12, rate: float = 0.25, l2: float = 2e-4) -> Field:
    """Maximum likelihood with a Gaussian prior, by AdaGrad on batches of made-up lines."""
    r = random.Random(seed)
    made = [_line(r) for _ in range(lines)]
    texts = [" ".join(w for w, _ in x) for x in made]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.r_[0, np.cumsum([len(x.encode()) for x in texts])]
    codes, *_, of = encode(raw, offsets)
    tags = np.array([y for x in made for _, y in x])
    n = np.bincount(of, minlength=lines)
    at = np.r_[0, np.cumsum(n)]
    w, t = [np.zeros((k, 3)) for k in SIZES], np.zeros((3, 3))
    g2w, g2t = [np.full((k, 3), 1e-6) for k in SIZES], np.full((3, 3), 1e-6)
    rng = np.random.default_rng(seed)
    by_size = np.argsort(n, kind="stable")
    batches = [b for b in np.array_split(by_size, max(1, lines // 64)) if len(b)]
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            b = batches[k]
            width = int(n[b].max())
            index = np.minimum(at[b][:, None] + np.arange(width), len(codes) - 1)
            inside = np.arange(width)[None] < n[b][:, None]
            c, y = codes[index], tags[index]
            p, pair = _forward_backward(sum(table[c[..., f]] for f, table in enumerate(w)), t, n[b])
            p[np.arange(len(b))[:, None], np.arange(width)[None], y] -= inside
            y = np.where(inside, y, O)
            padded = np.concatenate([np.zeros((len(b), 1), int), y, np.zeros((len(b), 1), int)], axis=1)
            real = np.arange(width + 1)[None] <= n[b][:, None]
            gt = (pair - np.bincount((3 * padded[:, :-1] + padded[:, 1:])[real], minlength=9).reshape(3, 3)) / len(b) + l2 * t
            for f in range(len(SIZES)):
                code = c[..., f][inside]
                g = np.stack([np.bincount(code, p[..., k][inside], SIZES[f]) for k in range(3)], axis=1) / len(b) + l2 * w[f]
                g2w[f] += g * g
                w[f] -= rate * g / np.sqrt(g2w[f])
            g2t += gt * gt
            t -= rate * gt / np.sqrt(g2t)
    return Field([x.astype(np.float32) for x in w], t.astype(np.float32))


def find(text: pa.Array, field: Field) -> Iterator[tuple[int, int, int]]:
    """(row, first byte, byte after the last) of each secret, without the quotes, or the name and sign of assignment, around it."""
    for first, _, raw, offsets in blocks(text, _PIECE):
        codes, _, _, cs, ce, of = encode(raw, offsets)
        if not len(codes):
            continue
        tags = field.decode(codes, of)
        at = np.flatnonzero(tags != O)
        if not len(at):
            continue
        new = np.r_[True, (tags[at[1:]] == B) | (np.diff(at) > 1) | (of[at[1:]] != of[at[:-1]])]
        cut = np.flatnonzero(new)
        for a, z in zip(at[cut], at[np.r_[cut[1:], len(at)] - 1]):
            begin, end = int(cs[a]), int(ce[z])
            inner = raw[begin : int(ce[a])].tobytes()
            sign = min((k for k in (inner.find(b"="), inner.find(b":")) if 0 < k < len(inner) - 6), default=-1)
            if sign > 0 and inner[:sign].replace(b"_", b"").replace(b"-", b"").replace(b'"', b"").isalpha():
                begin += sign + 1
                while begin < end - 1 and _EDGE[raw[begin]]:
                    begin += 1
            yield first + int(of[a]), begin - int(offsets[of[a]]), end - int(offsets[of[a]])


def _scan(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, begins, ends, values, text, held, seen, chars = [], [], [], [], b"", -1, 0, 0
            for row, begin, end in find(b.column(1), field):
                if row != held:
                    text, held, seen, chars = b.column(1)[row].as_py().encode(), row, 0, 0
                chars, seen = chars + len(text[seen:begin].decode()), begin  # they come in order: what lies between is read once
                rows.append(row)
                begins.append(chars)
                values.append(text[begin:end].decode("utf8", "replace"))
                ends.append(begins[-1] + len(values[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), pa.array(values, pa.string())], ["doc_id", "begin", "end", "secret"])

    return run


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, begin, end, secret): each secret found, by its characters' places in the text.

    Texts that are null, empty or blank have none; rows that repeat each give their rows; a null doc_id stays null. Of tags that
    score alike the first of outside, begin, inside is taken. Texts are used whole, as one sequence each; columns
    other than doc_id and text are left out.
    """
    return texts_of(docs).mapInArrow(_scan(field or train()), "doc_id bigint, begin int, end int, secret string")


def redact(docs: DataFrame, field: Field | None = None, mask: str = MASK) -> DataFrame:
    """docs, row by row, with each secret in text replaced by the mask, and n_chars, if there, counted again where text changed."""
    names = docs.columns
    at, model = names.index("text"), field or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[int, list[tuple[int, int]]] = {}
            for row, begin, end in find(b.column(at), model):
                found.setdefault(row, []).append((begin, end))
            if found:
                columns = b.columns
                text: dict[int, str] = {}
                size = columns[names.index("n_chars")].to_pylist() if "n_chars" in names else None
                for row, places in found.items():
                    raw, parts, at_byte = columns[at][row].as_py().encode(), [], 0
                    for begin, end in places:
                        parts += [raw[at_byte:begin], mask.encode()]
                        at_byte = end
                    text[row] = b"".join([*parts, raw[at_byte:]]).decode()
                    if size is not None:
                        size[row] = len(text[row])
                changed = np.zeros(b.num_rows, bool)
                changed[list(text)] = True
                columns[at] = pc.replace_with_mask(columns[at], pa.array(changed), pa.array([text[k] for k in sorted(text)], columns[at].type))
                if size is not None:
                    k = names.index("n_chars")
                    columns[k] = pa.array(size, columns[k].type)
                b = pa.RecordBatch.from_arrays(columns, schema=b.schema)
            yield b

    return docs.mapInArrow(run, docs.schema)


def op1_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
