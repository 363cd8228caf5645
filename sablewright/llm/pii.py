"""Personal data: base patterns, and a boosted classifier over high-recall candidates.

Base spans (``email``, ``ip``, ``card``, ``phone``) are exact patterns and are always reported. Generators then propose
overlapping candidates of further kinds; gradient-boosted trees score each from its format and the words around it,
isotonic calibration on rows kept out of the training turns scores into probabilities, and a threshold for each kind, set on
yet other rows for a wanted precision, selects the redactions. The tables hold no labels of personal data, so the trees are
trained on sentences made by ``training_rows`` from a seed; their number is a parameter.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablewright.llm.boosting import BoostedTrees, isotonic, threshold_for
from sablewright.llm.common import by_batch, field_of, small_batches

BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "local_phone", "national_id", "iban", "account", "written_email")
KINDS = BASE + EXTRA

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
#: The contract's pattern; a digit run is tried only from its start, as later starts in it would fail alike.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses. An address starts where the run of local characters before its @ does."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base matches by kind as listed in ``BASE``, then start; ends are exclusive, offsets in code points."""
    out = [("email", a, b) for a, b in emails(text)]
    if not _DIGITS.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _NOT_DIGIT.sub("", m[0]) if m.end() - m.start() < 64 else ""
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


#: Beginnings of well-known kinds of keys.
_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk-", "AIza", "eyJ")
_PREFIXED = re.compile(rf"(?<![A-Za-z0-9_-])(?:eyJ[A-Za-z0-9_-]{{8,}}+\.[A-Za-z0-9_-]{{8,}}+\.[A-Za-z0-9_-]{{8,}}+|(?:{'|'.join(_PREFIXES)})[A-Za-z0-9_-]{{14,}}+)")
_KEY_BEGIN, _KEY_END = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), re.compile(r"-----END [A-Z ]{0,40}PRIVATE KEY-----")
#: A name and the value that it is given; values without a digit are found only so.
_GIVEN = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z][A-Za-z0-9_.-]*+)[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"'`]?([^\s\"'`<>,;]{6,}+)")
_GIVEN_NAME = re.compile(r"pass(?:w|phrase|code)|pwd|secret|token|api.?key|access.?key|private.?key|credential", re.I)
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}+")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_TRUNK_PHONE = re.compile(r"(?<![0-9A-Za-z+(./-])\(?0[0-9]{1,5}\)?(?:[ ./-]{1,2}[0-9]{2,8}){1,5}+(?![0-9A-Za-z]|[./-][0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9+/_-])")
_ACCOUNT = re.compile(r"(?<![0-9A-Za-z.-])[0-9]{8,19}(?![0-9A-Za-z-]|\.[0-9])")
_WRITTEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[](?i:at)[)\]] ?[A-Za-z0-9-]++(?: ?[(\[](?i:dot)[)\]] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)+")


def candidates(text: str) -> list[tuple[str, int, int]]:
    """High-recall proposals of the further kinds; they may overlap each other and the base spans. No span is too long."""
    out, secrets = [], set()
    if "at)" in text.lower() or "at]" in text.lower():
        out += [("written_email", *m.span()) for m in _WRITTEN.finditer(text)]
    digits = _DIGITS.search(text)
    if digits:
        for m in _TOKEN.finditer(text):
            if _DIGITS.search(text, *m.span()) and any(map(str.isalpha, m[0])):
                secrets.add(m.span())
    if any(x in text for x in _PREFIXES):
        secrets.update(m.span() for m in _PREFIXED.finditer(text))
    if "=" in text or ":" in text:
        secrets.update(m.span(2) for m in _GIVEN.finditer(text) if _GIVEN_NAME.search(m[1][-64:]))
    at = 0
    while m := _KEY_BEGIN.search(text, at):
        end = _KEY_END.search(text, m.end())
        if end is None:
            break
        secrets.add((m.start(), end.end()))
        at = end.end()
    out += [("secret", a, b) for a, b in sorted(secrets)]
    if digits:
        phones = {m.span() for m in _LOCAL_PHONE.finditer(text)} | {m.span() for m in _TRUNK_PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 13}
        out += [("local_phone", a, b) for a, b in sorted(phones)]
        for kind, rx in (("national_id", _NATIONAL), ("iban", _IBAN), ("account", _ACCOUNT)):
            out += [(kind, m.start(), m.end()) for m in rx.finditer(text)]
    return out


#: Words near a span, by what they speak for.
_CUES = tuple(
    re.compile(x, re.I)
    for x in (
        r"token|secret|passw|passphrase|pwd|api.?key|access.?key|auth|bearer|credential|private.?key",
        r"phone|tel\b|call|mobile|fax|cell|whatsapp|telefon|mobil|anruf|appel|llam",
        r"\bssn\b|social|tax.?id|national.?id|identity|passport",
        r"iban|bank|account|konto|cuenta|compte|card|payment",
        r"mail|contact|reach|write",
        r"order|invoice|ref\b|version|isbn|sku|part|serial|ticket|issue|page|build|tracking",
        r"commit|sha|md5|hash|checksum|digest|uuid|guid|blob|tree|revision",
    )
)
_CONTEXT = 40


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format and context of one candidate."""
    s, before, after = text[a:b], text[max(0, a - _CONTEXT) : a], text[b : b + _CONTEXT]
    digits = _NOT_DIGIT.sub("", s)
    counts = [s.count(c) for c in set(s)]
    entropy = -sum(c / len(s) * math.log2(c / len(s)) for c in counts)
    iban = s.replace(" ", "").upper()
    groups = [len(x) for x in _DIGITS.findall(s)]
    good_iban = kind == "iban" and len(iban) > 4 and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    left = before.rstrip(" \"'`")
    return [
        *(float(kind == k) for k in EXTRA),
        len(s), len(digits) / len(s), sum(map(str.isupper, s)) / len(s), len(counts), entropy,
        sum(not c.isalnum() for c in s), max(groups, default=0), len(groups), min(groups, default=0), float(s.lstrip("(")[:1] == "0"), float(s[:1] in "${%[("), float("PRIVATE KEY" in s[:64]), float("." in s), float(s.isalpha()), float(s.isalpha() and s.islower()),
        float(13 <= len(digits) <= 19 and luhn(digits)), float(good_iban), float(all(c in "0123456789abcdefABCDEF" for c in s)),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", s))),
        float(s.startswith(_PREFIXES)), float(left[-1:] in "=:" and left != ""), float(before[-1:] in "\"'`" and before != ""), float(after[:1] in "\"'`" and after != ""), float(before[-1:] in "/.@#" and before != ""),
        *(float(bool(c.search(before))) for c in _CUES), *(float(bool(c.search(after))) for c in _CUES[:3]),
    ]


def training_rows(n: int, seed: int = 7) -> tuple[list[tuple[str, str, int, int]], list[int]]:
    """Candidates from ``n`` made sentences, each labelled by whether it is the planted personal datum."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    filler = lambda k: " ".join(word() for _ in range(k))
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k - 1)) + r.choice("0123456789")

    def iban() -> str:
        body = r.choice(("DE", "FR", "ES", "GB", "NL"))
        rest = d(r.choice((14, 16, 18)))
        check = 98 - int("".join(str(int(c, 36)) for c in rest + body + "00")) % 97
        s = f"{body}{check:02d}{rest}"
        return s if r.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    def card() -> str:
        body = d(15)
        return next(body + x for x in "0123456789" if luhn(body + x))

    name = lambda: r.choice(("token", "secret", "api_key", "apikey", "password", "access_key", "auth_token", "TOKEN", "API_KEY", "client_secret", "passwd", "db_password", "passphrase"))
    quote = lambda s: r.choice((f'"{s}"', f"'{s}'", s))
    base64 = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(k - 1)) + r.choice("0123456789")
    safe64 = lambda k: base64(k).replace("+", "-").replace("/", "_")

    def phrase() -> str:
        """A password without a digit."""
        some = [word() + word() for _ in range(r.randint(2, 4))]
        kind = r.randrange(4)
        return "-".join(some) if kind == 0 else "".join(x.capitalize() for x in some) if kind == 1 else r.choice("!#*&^").join(some) + r.choice("!#*?") if kind == 2 else "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(16, 40)))

    def pem() -> str:
        which = r.choice(("", "RSA ", "EC ", "OPENSSH "))
        return f"-----BEGIN {which}PRIVATE KEY-----\n" + "\n".join(base64(64) for _ in range(r.randint(1, 12))) + f"\n-----END {which}PRIVATE KEY-----"

    def trunk() -> str:
        return r.choice((f"0{d(2)}/{d(r.randint(6, 8))}", f"0{d(3)} {d(r.randint(6, 8))}", f"0{d(4)}-{d(6)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(2)} {d(4)} {d(4)}", f"(0{d(3)}) {d(6)}", f"0{d(4)} {d(3)} {d(3)}", f"0{d(2)}.{d(3)}.{d(2)}.{d(2)}"))

    positive = (
        lambda: (f"{name()} {r.choice('=:')} ", quote(r.choice((hexa, mixed))(r.choice((20, 24, 32, 40, 40, 64))))),
        lambda: (f"{name()}{r.choice('=:')}", quote(r.choice((hexa, mixed))(r.choice((20, 32, 40, 64))))),
        lambda: ("Authorization: Bearer ", mixed(r.choice((24, 40)))),
        lambda: (f"{name()} {r.choice('=:')} ", quote(r.choice((mixed, base64, safe64))(r.randint(65, 900)))),
        lambda: (r.choice(("Authorization: Bearer ", "token ", "jwt ", "", "cookie: ")), f"eyJ{safe64(r.randint(16, 60))}.eyJ{safe64(r.randint(40, 600))}.{safe64(43)}"),
        lambda: (f"{name()}{r.choice(('=', ': ', ' = '))}", quote(phrase())),
        lambda: (r.choice(("", "key\n", "as follows:\n")), pem()),
        lambda: (r.choice(("phone ", "call ", "tel. ", "Tel: ", "mobile: ", "fax ", "Telefon ", "appelez le ", "llame al ", "mobil ")), trunk()),
        lambda: (r.choice(("phone ", "call ", "tel. ", "Tel: ", "Telefon ")), trunk()),
        lambda: (r.choice(("", "", "key ", "with ")), r.choice(("AKIA", "ASIA")) + mixed(16).upper()),
        lambda: (r.choice(("", "", "key ", "with ")), r.choice(("ghp_", "glpat-", "xoxb-", "sk-", "AIza")) + mixed(r.choice((20, 30, 36)))),
        lambda: (r.choice(("phone ", "call ", "tel ", "Tel: ", "mobile: ", "fax ", "")), r.choice(("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}")).format(d(3), d(3), d(4))),
        lambda: (r.choice(("SSN ", "ssn: ", "social security number ", "tax id ", "")), f"{d(3)}-{d(2)}-{d(4)}"),
        lambda: (r.choice(("IBAN ", "bank account ", "iban: ", "")), iban()),
        lambda: (r.choice(("card ", "card no. ", "", "", "")), card()),
        lambda: (r.choice(("account number ", "bank account: ", "Konto ", "account no ")), d(r.choice((8, 10, 12)))),
        lambda: (r.choice(("mail ", "contact ", "write to ", "")), f"{word()}{r.choice(('.', '', '_'))}{word()} {r.choice(('(at)', '[at]', '(AT)', '[At]'))} {word()}{r.choice(('.', ' (dot) ', ' [dot] ', ' (DOT) '))}{r.choice(('com', 'org', 'de'))}"),
    )
    negative = (
        lambda: (r.choice(("commit ", "sha1 ", "md5 ", "sha256: ", "checksum = ", "hash: ", "tree/", "blob ", "revision ", "digest = ")), quote(hexa(r.choice((20, 32, 40, 40, 64))))),
        lambda: (r.choice(("uuid ", "id ", "guid = ", "")), f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}"),
        lambda: (r.choice(("data:image/png;base64,", "integrity sha512-", "src=data:font/woff;base64,", "blob ")), base64(r.randint(40, 900))),
        lambda: (r.choice(("https://www.", "see http://", "at ")), f"{word()}{word()}.com/{word()}/{r.choice((d(4) + '/' + d(2), d(4) + '-' + d(2) + '-' + d(2)))}-{word()}-{word()}-{word()}-{d(r.randint(3, 8))}"),
        lambda: (r.choice(("see ", "", "in ", "from ")), f"/{word()}/{word()}/{word()}{d(1)}-{word()}/{word()}-{word()}-{d(r.randint(3, 8))}/{word()}"),
        lambda: (f"{name()}{r.choice((' = ', ': ', '='))}", r.choice((word() + word() + word(), "${" + word().upper() + "_KEY}", f"$({word()}{word()})", "required", "optional", "string", "see " + word(), "os.environ[KEY]", "********", "xxxxxxxx", f"get_{word()}()", f"config.{word()}.{word()}"))),
        lambda: (f"{name()}{r.choice((' = ', ': '))}", word() + word() + word() + " " + word()),
        lambda: (r.choice(("on ", "", "date ", "since ", "version ", "at ")), r.choice((f"0{r.randint(1, 9)}.0{r.randint(1, 9)}.20{d(2)}", f"0{r.randint(1, 9)}-1{r.randint(0, 2)}-20{d(2)}", f"0{r.randint(1, 9)}/1{r.randint(0, 2)}/20{d(2)} 10", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0.{d(8)}", f"0{d(3)}-{d(4)}-{d(3)}"))),
        lambda: (r.choice(("part ", "order ", "ticket ", "isbn ", "values ")), trunk()),
        lambda: (r.choice(("", "see ", "file ", "/data/")), f"{word()}-{word()}-{word()}-{d(2)}-{word()}"),
        lambda: (r.choice(("", "in ")), f"{word()}{word()}{word()}_{d(4)}_{word()}"),
        lambda: (r.choice(("order ", "invoice ", "ref ", "serial ", "ticket ", "tracking ", "")), d(r.randint(8, 19))),
        lambda: (r.choice(("", "at ", "on ", "from ")), d(r.randint(12, 18))),
        lambda: (r.choice(("", "at ", "")), d(16)),
        lambda: (r.choice(("part ", "sku ", "order ", "serial ", "isbn ")), f"{d(3)}-{d(3)}-{d(4)}"),
        lambda: (r.choice(("part ", "page ", "sku ", "version ")), f"{d(3)}-{d(2)}-{d(4)}"),
        lambda: (r.choice(("model ", "part ", "")), f"{r.choice(('AB', 'QX', 'ZK'))}{d(2)} {d(4)} {d(4)}"),
    )
    rows, labels = [], []
    for i in range(n):
        pos = i % 2 == 0
        cue, item = r.choice(positive if pos else negative)()
        head = filler(r.randint(2, 8)) + r.choice((" ", ". ", ", ", " | ", " ")) + cue
        text = head + item + r.choice((" ", ". ", ", ", "!! ", "\n", "### ")) + filler(r.randint(2, 8))
        if r.random() < 0.2:  # shouted texts
            text, head = text.upper(), head.upper()
        for kind, a, b in candidates(text):
            if b > len(head) and a < len(head) + len(item):
                rows.append((text, kind, a, b))
                labels.append(int(pos and (kind != "account" or luhn(text[a:b]) and b - a == 16 or "account" in cue.lower() or "konto" in cue.lower())))
    return rows, labels


class PiiModel:
    """Trees, calibration and thresholds; a few tens of kilobytes, so it travels with the tasks."""

    def __init__(self, n_train: int = 12_000, precision: float = 0.98, seed: int = 7):
        rows, y = training_rows(n_train, seed)
        x, y = np.array([features(*r) for r in rows]), np.array(y, float)
        # half of the rows train the trees, a quarter calibrates them and a quarter sets the thresholds
        kinds, part = np.array([r[1] for r in rows]), np.arange(len(rows)) % 4
        self.trees = BoostedTrees().fit(x[part < 2], y[part < 2])
        self.knots = isotonic(self.trees.raw(x[part == 2]), y[part == 2])
        last = part == 3
        p, y, kinds = self._probability(self.trees.raw(x[last])), y[last], kinds[last]
        self.threshold = {k: max(0.5, threshold_for(p[m], y[m], precision)) if (m := kinds == k).any() else 1.01 for k in EXTRA}

    def _probability(self, z: np.ndarray) -> np.ndarray:
        return np.interp(z, *self.knots)

    def select(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """The accepted candidates that overlap no base span and no likelier accepted one."""
        found = candidates(text)
        if not found:
            return []
        p = self._probability(self.trees.raw(np.array([features(text, *c) for c in found])))
        # taken spans as disjoint ones in order
        starts, ends = [], []
        for a, b in sorted((a, b) for _, a, b in base):
            if ends and a < ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
        out = []
        for i in sorted(range(len(found)), key=lambda i: (-p[i], KINDS.index(found[i][0]), found[i][1])):
            k, a, b = found[i]
            at = bisect_right(starts, a)
            if p[i] >= self.threshold[k] and (not at or ends[at - 1] <= a) and (at == len(starts) or b <= starts[at]):
                starts.insert(at, a)
                ends.insert(at, b)
                out.append(found[i])
        return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


@functools.lru_cache(maxsize=2)
def model(n_train: int = 12_000, precision: float = 0.98, seed: int = 7) -> PiiModel:
    return PiiModel(n_train, precision, seed)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one replacement."""
    out, free = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= free:
            continue
        if a >= free:
            out += [text[free:a], f"<{k.upper()}>"]
        free = b
    return "".join([*out, text[free:]])


def _map(docs: DataFrame, ddl: str, fields: list[pa.Field], id_col: str, text_col: str, row) -> DataFrame:
    small_batches(docs.sparkSession)
    own, id_ddl = field_of(docs, id_col, "__id")
    schema = pa.schema([own, *fields])
    m = model()

    def make():
        def run(cols):
            rows = [(key, *row(m, text or "")) for key, text in zip(cols["__id"], cols["__text"], strict=True)]
            return dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True))

        return run

    out = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(by_batch(make, schema), f"{id_ddl}, {ddl}")
    return out.withColumnRenamed("__id", id_col)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, a count for each base kind, ``base_sha256``, ``spans`` and ``n_added``.

    A null text counts as empty: no spans, the hash of no bytes. Whole texts are searched. Repeated rows give repeated
    results; other columns are not carried. One narrow pass; no shuffle.
    """

    def row(m, text):
        base = base_spans(text)
        added = m.select(text, base)
        n = [sum(s[0] == k for s in base) for k in BASE]
        return (*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added))

    fields = [*(pa.field(f"n_{k}", pa.int64()) for k in BASE), pa.field("base_sha256", pa.string()), pa.field("spans", pa.string()), pa.field("n_added", pa.int64())]
    ddl = ", ".join(f"n_{k} bigint" for k in BASE) + ", base_sha256 string, spans string, n_added bigint"
    return _map(docs, ddl, fields, id_col, text_col, row)


def op1_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
