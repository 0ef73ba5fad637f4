"""Credentials in source code, configuration, commands and notes: found and redacted.

A lexer cuts a line into tokens (names, operators, quotes, literal values, the parts of a URL
with user information, whole private-key blocks).  A linear-chain conditional random field
labels the tokens with shape features of the literal and context features (the name it is
given to, the call it stands in, operators and quotes around it); the Viterbi path decides
which tokens are secret, and exactly their characters are reported and redacted.  A literal
alone on its line is read together with the line that opens it (``password:``, ``API_KEYS = [``).

A literal without a credential's name or option on its line and without a form that tells by
itself (a vendor's prefix, a web token, a key block) has one feature, its bare form, and the
trained weight of every bare form is negative.  Lines without any of ``CUES`` hold only such
literals, so they are passed over without a loss; tests run the field over all lines of a
table to show it.  Literals of any length are looked at.  The field is trained on generated
lines (``credentials_training``), deterministically, once per driver process, and broadcast as
a table of weights of a few kilobytes.  Finding is a map over the rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARK = "[REDACTED]"

#: A literal of more characters is classed by its alphabet only, in linear time.
LONG = 400

#: Beginnings of literals that tell by themselves, and the middle parts of other vendors' forms.
VENDOR_STARTS = (
    "ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- xoxa- xoxb- xoxp- xoxr- xoxs- sk- sk_ rk_ pk_live AKIA ASIA AIza ya29. npm_ hf_ "
    "dop_v1_ SG."
).split()
VENDOR_MIDDLES = "live key pat prod tok test sec".split()

#: Without one of these in a line (lower case) no token of it has more than its bare form.
CUES = (
    *"pass pwd secret token key cred auth bearer basic pw login signing hmac -----begin eyj".split(),
    *(" -p", "\t-p", " -u", "\t-u", "--user"),
    *(x.lower() for x in VENDOR_STARTS),
    *(f"_{x}_" for x in VENDOR_MIDDLES),
)
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*)-----.*?-----END \1-----", re.S)
_LEX = re.compile(
    r"""(?P<scheme>[A-Za-z][A-Za-z0-9+.-]*://)(?P<user>[^\s:/@"'`<>\\]*)(?P<colon>:)(?P<pw>[^\s"'`/<>\\]+)(?P<at>@)(?=[\w$\[{])
    |(?P<q>\\?["'`])
    |(?P<esc>\\.)
    |(?P<space>\s+)
    |(?P<d>[()\[\]{}<>,;|])
    |(?P<chunk>[^\s"'`\\()\[\]{}<>,;|]+)""",
    re.X,
)
_USER_INFO = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@"'`<>\\]*:[^\s"'`/<>\\]+@(?=[\w$\[{])""")
_ASSIGN = re.compile(r"([A-Za-z_$-][\w.$-]*)(:=|=>|==|=|:)(.+)", re.S)
_GLUED = re.compile(r"-p(?=.*[\d_.~&?!%+^$#*=-])([^-=\s][^\s]{2,})")
_NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: A line that holds one literal and no more.
_LONE = re.compile(r"\s*[+-]?\s*(?:[-*]\s+)?(?:\"[^\"]*\"|'[^']*'|`[^`]*`|[^\s\"'`:=(){}\[\]]+)[\s,;)\]}]*\\?\s*")
_OPENS = frozenset([":", "=", ":=", "=>", "[", "(", "{", "|", ">", "\\", ","])

#: Words that name a credential, words that turn such a name into a setting, words for checksums and ids.
PASSWORD_WORDS = frozenset("pass password passwd pwd passphrase passcode pw dbpassword userpass".split())
CREDENTIAL_WORDS = PASSWORD_WORDS | frozenset(
    "secret token key apikey credential cred auth bearer authorization login signing hmac clientsecret servicecredential basic".split()
)
PLURALS = frozenset("passwords passphrases passcodes secrets tokens keys apikeys credentials creds".split())
SETTING_WORDS = frozenset(
    "file path dir name names url uri id ids length len min max limit ttl count policy expiry expires rotation public "
    "hint type ref size per days hours minutes enabled required header version source prefix alias label field store "
    "cache primary partition sort foreign routing object row idempotency dedup group index".split()
)
AMOUNTS = frozenset("max min limit count ttl size len length".split())
CHECKSUM_WORDS = frozenset(
    "sha sha1 sha256 md5 checksum digest hash commit etag fingerprint integrity revision uuid trace request build "
    "certificate cert serial".split()
)
_FUSED = re.compile(
    r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|credentials?|auth|bearer|pw|(?:api|app|access|secret|private|master|sign(?:ing)?|"
    r"encryption|auth|client|session|license|account|shared|service|deploy|admin|user|db)key)$"
)
_PLACEHOLDER = re.compile(
    r"(?i)^(?:x{3,}|\*{3,}|\.{3,}|-+|_+|0+|null|none|nil|true|false|undefined|empty|todo|tbd|n/a|<.*>|\[.*\]|changeme|change[-_]me|"
    r"replace[-_]?me|redacted|.*redacted.*|placeholder|dummy|(?:your|example|sample|my|insert|enter)[-_].*|fixme|secret|password|token|test|"
    r"required|optional|enabled|disabled|hidden|prompt|ask|unset|missing|invalid|expired|yes|no|on|off|string|str|bytes|never|always)$"
)
_REFERENCE = re.compile(
    r"(?i)^(?:\$.*|%[A-Z_]+%|.*\$\{.*|.*\{\{.*|env:.*|vault:.*|vault\..*|file:.*|secretref.*|arn:.*|ssm:.*|process\.env.*|os\.environ.*|"
    r"os\.getenv.*|/run/.*|/etc/.*|secrets?/.*|.*\.env\..*|system\.getenv.*|config\..*|settings\..*)"
)
_PART = r"[a-z]+|[A-Z]+|[A-Z]?[a-z]+(?:[A-Z][a-z]{2,})+|[A-Z][a-z]+"
_SHAPES = [
    ("pem", re.compile(r"^-----BEGIN")),
    # behind a vendor's prefix a run that is no word: with a digit, or very long
    ("known", re.compile(r"^(?:%s)(?=[\w.-]*?(?:(?=[A-Za-z]*\d)[A-Za-z0-9]{10}|[A-Za-z]{30}))[\w.-]{8,}" % "|".join(map(re.escape, VENDOR_STARTS)))),
    ("vendor", re.compile(r"^[a-z]{2,5}_(?:%s)_(?=[A-Za-z]*\d)(?=[a-z0-9]*[A-Z])[A-Za-z0-9]{12,}$" % "|".join(VENDOR_MIDDLES))),
    ("jwt", re.compile(r"^eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]*")),
    ("uuid", re.compile(r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")),
    ("digest", re.compile(r"(?i)^(?:sha\d+|md5)[:-]")),
    ("sshkey", re.compile(r"^(?:ssh-|ecdsa-|AAAA[A-Z])")),
    ("hex", re.compile(r"^(?=.*\d)(?:[0-9a-f]{16,}|[0-9A-F]{16,})$")),
    ("number", re.compile(r"^[\d.,:_+-]+[a-z%]{0,2}$")),
    ("url", re.compile(r"^(?:https?|[a-z]+)://|^[\w-]+(?:\.[\w-]+)*\.(?:com|org|net|io|example|test|invalid|internal|local)(?:[:/].*)?$")),
    ("filepath", re.compile(r"^[~.]{0,2}/?(?:[\w.-]+/)+[\w.-]*\.[A-Za-z]{1,5}$|^[~.]{0,2}/(?:[a-z][\w.-]*/)+[a-z][\w.-]*$")),
    ("wordmix", re.compile(r"^[A-Z][a-z]+[^\w\s]?_?\d{2,5}[a-z]+$")),
    ("phrase", re.compile(r"^[a-z]+(?:[^\w\s]|_)[a-z]+(?:[^\w\s]|_)[a-z]+\d{2,}$")),
    ("mixed", re.compile(r"^[a-z]+[^\w\s.-][a-z]+\d{2,}$")),
    ("leet", re.compile(r"^(?=[a-z]*\d)[a-z0-9]{4,10}[-_.~&?!%+=^$#*][A-Za-z0-9]{4,6}$")),
    ("base64", re.compile(r"^(?=.*[A-Z])(?=.*[a-z])(?=.*[0-9/+])[A-Za-z0-9+/]{20,}={0,2}$")),
    ("camel", re.compile(r"^[A-Za-z][a-z]+(?:[A-Z][a-z]+)+\d{0,2}$")),
    ("words", re.compile(r"^(?:%s)(?:[-_.](?:%s))*(?:[-_]?[xv]?\d{1,2})?[.:]?$" % ((_PART,) * 2))),
]


_SELF_TELLING = frozenset(["pem", "known", "vendor", "jwt"])
_LONG_SHAPES = [
    ("jwt", _SHAPES[3][1]),
    ("hex", re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")),
    ("base64", re.compile(r"[A-Za-z0-9+/]+={0,2}")),
]


class Token:
    __slots__ = ("text", "start", "end", "kind", "quoted")

    def __init__(self, text, start, end, kind, quoted=False):
        self.text, self.start, self.end, self.kind, self.quoted = text, start, end, kind, quoted


@lru_cache(maxsize=20_000)
def name_class(name: str) -> str:
    """pw, cred, many (a plural), setting, sum or none: what a name says about the value it is given to."""
    parts = [w.lower() for w in _NAME_WORD.findall(name)]
    at = max((k for k, p in enumerate(parts) if p in CREDENTIAL_WORDS or p in PLURALS), default=-1)
    if at < 0:
        if any(p in CHECKSUM_WORDS for p in parts):
            return "sum"
        return "cred" if parts and _FUSED.search("".join(parts)) else "none"
    word, before, after = parts[at], parts[:at], parts[at + 1 :]
    if any(p in SETTING_WORDS for p in after) or "public" in before:
        return "setting"
    if any(p in CHECKSUM_WORDS for p in after):
        return "sum"
    # "cache" says what a key is for and "max" what a number of tokens is; before other words they only say whose it is
    if before and (word in ("key", "keys") and before[-1] in SETTING_WORDS or word in ("token", "tokens") and before[-1] in AMOUNTS):
        return "setting"
    if before and word in ("key", "keys") and before[-1] in CHECKSUM_WORDS:
        return "sum"
    if word in PLURALS:
        return "many"
    return "pw" if word in PASSWORD_WORDS else "cred"


def shape(text: str) -> str:
    """The class of a literal, by its form alone."""
    if len(text) > LONG:
        return next((label for label, p in _LONG_SHAPES if p.fullmatch(text)), "long")
    return _shape(text)


@lru_cache(maxsize=20_000)
def _shape(text: str) -> str:
    if _PLACEHOLDER.match(text):
        return "placeholder"
    if _REFERENCE.match(text):
        return "reference"
    for label, pattern in _SHAPES:
        if pattern.match(text):
            return label
    classes = sum(bool(re.search(p, text)) for p in ("[a-z]", "[A-Z]", r"\d", r"[^A-Za-z0-9]"))
    if classes >= 3 and len(text) >= 6:
        return "random"
    return f"other{classes}"


def _refine(text: str, start: int, first: bool, flag: str, out: list) -> None:
    """An unquoted run of characters: option names, assignments, trailing punctuation."""
    end = start + len(text)
    if first and len(text) > 1 and text[0] in "+-" and text[1] not in "+-" and (text[1].isalnum() or text[1] == "_"):
        if not re.match(r"-[a-zA-Z]$", text):
            out.append(Token(text[0], start, start + 1, "punct"))
            text, start = text[1:], start + 1
    tail = len(text.rstrip(".:!?" if len(text) > 1 else ""))
    body, rest = text[:tail], text[tail:]
    m = _ASSIGN.fullmatch(body)
    if m:
        name, op, value = m.groups()
        if (
            first
            or name.startswith("-")
            or name_class(name) != "none"
            or name.isupper() and len(name) > 2
        ) and not (op == ":" and value.startswith("//")):
            at = start + len(name)
            out.append(Token(name, start, at, "name"))
            out.append(Token(op, at, at + len(op), "op"))
            out.append(Token(value, at + len(op), start + tail, "word"))
            body = ""
        elif op == ":" and flag in ("-u", "--user"):
            at = start + len(name)
            out += [Token(name, start, at, "name"), Token(":", at, at + 1, "op"), Token(value, at + 1, start + tail, "pw")]
            body = ""
    glued = _GLUED.fullmatch(body)
    if glued:  # an option with its value, without a blank
        out += [Token("-p", start, start + 2, "name"), Token(glued.group(1), start + 2, start + tail, "pw")]
        body = ""
    elif (
        body.endswith("=")
        and body[:-1].replace(".", "").replace("-", "").isidentifier()
        and (name_class(body[:-1]) != "none" or shape(body[:-1]) not in ("base64", "random", "hex", "known", "leet"))
    ):
        out += [Token(body[:-1], start, start + tail - 1, "name"), Token("=", start + tail - 1, start + tail, "op")]
        body = ""
    if body:
        out.append(Token(body, start, start + tail, "op" if not any(c.isalnum() for c in body) else "word"))
    if rest:
        out.append(Token(rest, start + tail, end, "op"))


def lex(line: str, offset: int = 0) -> list[Token]:
    """Tokens of one line; ``offset`` is added to all places."""
    out: list[Token] = []
    pos, first, flag = 0, True, ""
    n = len(line)
    while pos < n:
        m = _LEX.match(line, pos)
        if m is None:
            pos += 1
            continue
        kind = m.lastgroup
        if kind == "at":
            for g, k in (("scheme", "scheme"), ("user", "user"), ("colon", "op"), ("pw", "pw"), ("at", "op")):
                if m.group(g):
                    out.append(Token(m.group(g), m.start(g), m.end(g), k))
        elif kind == "q":
            quote = m.group()
            out.append(Token(quote, m.start(), m.end(), "quote"))
            close = line.find(quote, m.end())
            inner = line[m.end() : close] if close > m.end() else ""
            if inner and not re.search(r"\s", inner) and (len(quote) > 1 or "\\" not in inner) and "://" not in inner:
                a = _ASSIGN.fullmatch(inner)
                if a and name_class(a.group(1)) != "none" and a.group(1).isidentifier() and a.group(2) == "=":
                    _refine(inner, m.end(), True, "", out)
                else:
                    out.append(Token(inner, m.end(), close, "word", True))
                out.append(Token(quote, close, close + len(quote), "quote"))
                pos, first, flag = close + len(quote), False, ""
                continue
        elif kind == "chunk":
            chunk = m.group()
            url = _USER_INFO.search(line, pos) if "://" in chunk else None
            if url and pos < url.start() < m.end():  # a URL right behind an operator
                _refine(line[pos : url.start()], pos, first, flag, out)
                pos, first, flag = url.start(), False, ""
                continue
            _refine(chunk, pos, first, flag, out)
            flag = chunk
        elif kind in ("esc", "d"):
            out.append(Token(m.group(), m.start(), m.end(), "punct"))
        if kind != "space":
            first = False
        pos = m.end()
    if offset:
        for t in out:
            t.start += offset
            t.end += offset
    return out


_CANDIDATE = {"word", "pw", "pem"}
_NAMES = {"pw", "cred", "many", "setting", "sum"}
_OPTIONS = {"bearer", "basic", "-p", "-u", "--password", "--token", "--secret", "--user"}
_READS = re.compile(r"(?i)(?:\w+\.)*(?:get|read|load|fetch|lookup)")


def names_of(tokens: list[Token]) -> list[str]:
    """What each token says as a name; a word for a checksum does so only before an operator or a quote."""
    out = [name_class(t.text) if t.kind in ("word", "name") and len(t.text) <= 60 else "none" for t in tokens]
    for i, x in enumerate(out):
        if x == "sum" and (i + 1 == len(tokens) or tokens[i + 1].kind not in ("op", "quote")):
            out[i] = "none"
    return out


def features(tokens: list[Token]) -> list[list[str]]:
    """Shape and context features of each token."""
    out = []
    names = names_of(tokens)
    named = any(x != "none" for x in names)
    for i, t in enumerate(tokens):
        if t.kind not in _CANDIDATE:
            out.append([f"kind={t.kind}"])
            continue
        if t.kind == "pem":
            form = "pem:" + ("private" if "PRIVATE KEY" in t.text[:60] else "other")
        else:
            form = shape(t.text)
        prev = [tokens[j].text.lower() if j >= 0 else "^" for j in (i - 1, i - 2, i - 3)]
        key, distance, call, crossed = "none", 0, "", ""
        j, steps = i - 1, 0
        while named and j >= 0 and steps < 9:
            text = tokens[j].text
            if names[j] != "none":
                key, distance = names[j], steps
                if j + 1 < len(tokens) and tokens[j + 1].text == "(" and _READS.match(text):
                    call = "get"
                break
            if text in (",", ";", "}", "|") and steps > 0:
                crossed += text
            if tokens[j].kind in ("word", "name") and len(text) > 1:
                steps += 2
            else:
                steps += 1
            j -= 1
        if key == "none" and t.kind == "word" and form not in _SELF_TELLING and prev[0] not in _OPTIONS:
            out.append([f"bare={form}"])
            continue
        after = tokens[i + 1].text.lower()[:12] if i + 1 < len(tokens) else "$"
        if call == "" and prev[0] in ("(", '"', "'") and any(_READS.match(p) for p in prev[1:]):
            call = "get"
        link = "".join(x.text if len(x.text) < 3 else "w" for x in tokens[max(j + 1, 0) : i])[:10] if key != "none" else ""
        own = names[i]
        f = [
            f"kind={t.kind}",
            f"form={form}",
            f"key={key}",
            f"key={key}|form={form}",
            f"kind={t.kind}|form={form}",
            f"dist={min(distance, 6)}|key={key}",
            f"prev={prev[0][:10]}",
            f"prev={prev[0][:10]}|key={key}",
            f"next={after}",
            f"link={link}",
            f"link={link}|key={key}|form={form}",
            f"own={own}",
            f"own={own}|form={form}",
            f"quoted={t.quoted}|form={form}",
            f"len={min(len(t.text) // 6, 6)}",
            f"len={min(len(t.text), 6)}|key={key}",
            f"crossed={crossed[:2]}|key={key}",
        ]
        if len(t.text) > LONG:
            f.append(f"long|key={key}|form={form}")
        if call:
            f.append("call=get")
        if prev[0] in _OPTIONS or prev[0] in ("is", "was"):
            f.append(f"cue={prev[0]}|form={form}")
        out.append(f)
    return out


def viterbi(scores: list[float], trans: tuple) -> list[int]:
    """Best labels (0 plain, 1 secret) for emission scores of label 1 and (start1, t00, t01, t10, t11)."""
    start1, t00, t01, t10, t11 = trans
    a, b, back = 0.0, start1 + scores[0], []
    for s in scores[1:]:
        x0, x1 = a + t00, b + t10
        y0, y1 = a + t01, b + t11
        back.append((x1 > x0, y1 > y0))
        a, b = max(x0, x1), max(y0, y1) + s
    label = int(b > a)
    out = [label]
    for to0, to1 in reversed(back):
        label = int(to1 if label else to0)
        out.append(label)
    return out[::-1]


class Field:
    """A trained conditional random field over tokens."""

    def __init__(self, weights: dict[str, float], trans: tuple):
        self.weights, self.trans = weights, trans
        start1, t00, t01, t10, t11 = trans
        # with all scores below this no path through a secret beats the plain one
        self.floor = -max(max(start1, t01 - t00) + max(t10 - t00, 0.0), t11 - t00) - 1e-9

    def secrets_of_line(self, tokens: list[Token]) -> list[tuple[int, int]]:
        get = self.weights.get
        scores = [sum([get(f, 0.0) for f in fs]) for fs in features(tokens)]
        if not scores or max(scores) < self.floor:
            return []
        labels = viterbi(scores, self.trans)
        spans: list[list[int]] = []
        for t, y in zip(tokens, labels):
            if not y:
                continue
            if spans and spans[-1][1] == t.start:
                spans[-1][1] = t.end
            else:
                spans.append([t.start, t.end])
        return [tuple(s) for s in spans]

    def find(self, text: str | None, every_line: bool = False) -> list[tuple[int, int]]:
        """Places of the secrets in a text; with ``every_line`` also lines without cues are lexed."""
        if not text or not (every_line or may_hold(text.lower())):
            return []
        out: list[tuple[int, int]] = []
        blocks = list(_PEM.finditer(text)) if "-----BEGIN" in text else []
        pos, held = 0, []  # tokens of a line that holds a key block
        opener: list[Token] = []
        for block in [*blocks, None]:
            at = pos
            lines = text[pos : block.start() if block else len(text)].split("\n")
            for k, line in enumerate(lines):
                if k and held:
                    out += self.secrets_of_line(held)
                    held = []
                if held or block and k == len(lines) - 1:
                    held, opener = held + lex(line, at), []
                elif opener and _LONE.fullmatch(line):
                    out += [s for s in self.secrets_of_line(opener + lex(line, at)) if s[0] >= at]
                    bare = line.strip().lstrip("+ ")
                    if not (bare.startswith("- ") or bare.endswith(",")):
                        opener = []
                elif every_line or may_hold(line.lower()):
                    tokens = lex(line, at)
                    out += self.secrets_of_line(tokens)
                    opener = opening(tokens)
                else:
                    opener = []
                at += len(line) + 1
            if block:
                held.append(Token(block.group(), block.start(), block.end(), "pem"))
                pos = block.end()
        if held:
            out += self.secrets_of_line(held)
        return out


def may_hold(low: str) -> bool:
    """Whether a lower-case text has a cue, or a URL that may hold user information."""
    for cue in CUES:
        if cue in low:
            return True
    return "://" in low and "@" in low or low.startswith(("-p", "-u"))


def opening(tokens: list[Token]) -> list[Token]:
    """The end of a line, if it names a credential and leaves the value to the next line."""
    if tokens and tokens[-1].text in _OPENS and any(x in ("pw", "cred", "many") for x in names_of(tokens[-4:])):
        return tokens[-5:]
    return []


def redact(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text with the given places replaced and all other characters unchanged."""
    for a, b in sorted(spans, reverse=True):
        text = text[:a] + MARK + text[b:]
    return text


@lru_cache(maxsize=1)
def trained() -> Field:
    from cairnflow.llm.credentials_training import train

    return Field(*train())


def redact_credentials(rows: DataFrame, row_id: str, fields: tuple[str, ...]) -> DataFrame:
    """``id``, ``<field>_redacted`` for each field, and ``secrets``: array of (field, start, end, secret).

    Every row comes out once; a null field stays null, a field without secrets is unchanged.
    ``start`` and ``end`` count characters (code points) of the stored string.  Extra columns
    are ignored.
    """
    shared = rows.sparkSession.sparkContext.broadcast(trained())
    slim = rows.select(F.col(row_id).alias("id"), *[F.col(f) for f in fields])
    outs = [f"{f}_redacted" for f in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = shared.value.find
        for pdf in batches:
            columns = {f: pdf[f].tolist() for f in fields}
            found = [[] for _ in range(len(pdf))]
            for f, values in columns.items():
                for k, text in enumerate(values):
                    if spans := find(text):
                        found[k] += [{"field": f, "start": a, "end": b, "secret": text[a:b]} for a, b in spans]
                        values[k] = redact(text, spans)
            yield pd.DataFrame({"id": pdf["id"], **dict(zip(outs, columns.values())), "secrets": found})

    schema = f"id {dict(slim.dtypes)['id']}, {', '.join(f'{o} string' for o in outs)}, secrets array<struct<field:string,start:int,end:int,secret:string>>"
    return slim.mapInPandas(run, schema)


def found_secrets(rows: DataFrame, row_id: str, fields: tuple[str, ...]) -> DataFrame:
    """``id, field, secret``: each distinct secret of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(trained())
    slim = rows.select(F.col(row_id).alias("id"), *[F.col(f) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.find
        for batch in batches:
            row, field, secret = [], [], []
            for f in fields:
                for k, text in enumerate(batch.column(f).to_pylist()):
                    for a, b in find(text):
                        row.append(k)
                        field.append(f)
                        secret.append(text[a:b])
            ids = batch.column("id").take(pa.array(row, pa.int64()))
            yield pa.record_batch([ids, pa.array(field, pa.string()), pa.array(secret, pa.string())], names=["id", "field", "secret"])

    return slim.mapInArrow(run, f"id {dict(slim.dtypes)['id']}, field string, secret string").distinct()
