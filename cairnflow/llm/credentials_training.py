"""Training of the token field on generated lines.

``LINES`` generated lines (the bound of the training sample) with known secrets are lexed by
the same lexer, and the weights of the conditional random field are fitted to the exact
conditional likelihood by forward-backward and Adam.  Everything is seeded.
"""

from __future__ import annotations

import base64
import random

import numpy as np

from cairnflow.llm.credentials import LONG, Token, features, lex, name_class, shape

#: Generated lines and passes over them.
LINES, PASSES = 8_000, 60

_WORDS = (
    "maple river copper cloud north engine parser falcon meadow silver amber tiger ocean forest pilot rocket garden "
    "window bridge harbor castle marble violet cedar planet saddle mirror lantern bucket worker ledger shadow summit "
    "canyon velvet tunnel pepper orchid puzzle timber signal basket ribbon anchor helmet candle magnet kernel"
).split()
_CREDENTIALS = (
    "password passwd pwd db_pass dbPassword userPass admin_password smtp_pass login_pw passphrase secret client_secret "
    "clientSecret webhook_secret token access_token auth_token refresh_token private_token api_key apikey apiKey "
    "signing_key hmac_key encryption_key service_credential serviceCredential redis_auth bearer private_key tls_key "
    "secretKey access_key session_secret jwt_secret master_key"
).split()
_SETTINGS = (
    "password_file password_min_length token_limit max_tokens secret_name key_id public_key token_ttl secret_path "
    "password_policy key_size auth_url token_type api_key_header credential_store key_rotation_days max_tokens_per_job "
    "auth_enabled token_count passwd_file client_id key_name secret_ref_name cache_key primary_key sort_key routing_key "
    "partition_key idempotency_key object_key"
).split()
_CHECKSUMS = "sha256 commit checksum etag digest request_id trace_id build_hash md5 fingerprint cert_serial".split()
#: Whose a credential is; some of these words elsewhere make a name a setting.
_OWNERS = "cache store index header group field queue agent batch source label object worker row".split()
_PLURALS = "API_KEYS tokens passwords api_keys secrets access_tokens signingKeys credentials".split()
_PLAIN_PASSWORDS = (
    "sunshine dragon monkey hunter letmein qwerty welcome princess football shadow master trustno starwars freedom whatever abc iloveyou "
    "summer winter flower cheese banana secretword opensesame"
).split()
_STATES = "required optional enabled disabled hidden prompt ask unset missing invalid expired yes no on off string str bytes always never".split()
_OTHERS = "image host queue region path level target cache branch name user topic bucket zone title".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self):
        return self.r.choice(_WORDS)

    def chars(self, alphabet, lo, hi):
        return "".join(self.r.choice(alphabet) for _ in range(self.r.randint(lo, hi)))

    def ident(self):
        r, a, b = self.r, self.word(), self.word()
        return r.choice([f"{a}_{b}", f"{a}-{b}", a + b.title(), f"{a.title()}{b.title()}", f"{a}_{b}{r.randrange(99)}", f"{a}-{b}-{self.word()}", a])

    def name(self, base):
        r = self.r
        owner = r.choice(_OWNERS) if r.random() < 0.4 and base not in ("key", "token") else self.word()
        n = r.choice([base, base, base, f"{owner}_{base}", f"{owner}.{base}"])
        return r.choice([n, n, n.upper().replace(".", "_")])

    def secret(self):
        r = self.r
        alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        sign = r.choice("-_.~+=&%!?^$*#")
        kind = r.randrange(15)
        if kind == 14:
            if r.random() < 0.3:
                return self.chars(alnum[:52], 16, 30)
            return self.chars(alnum, 30, 60) if r.random() < 0.5 else base64.b64encode(f"{self.word()}:{self.word().title()}_{r.randrange(999)}{self.word()}".encode()).decode()
        if kind == 0:
            return f"{self.word().title()}{sign}{r.randrange(100, 9999)}{self.word()}"
        if kind == 1:
            return f"{self.word()}{sign}{self.word()}{r.choice('-_.~+&%!^$*#')}{self.word()}{r.randrange(10, 99)}"
        if kind == 2:
            w = self.word()
            if r.random() < 0.3:
                return f"{w}{sign}{self.chars(alnum, 5, 5)}"
            w = w.replace("e", "3", 1).replace("a", "4", 1).replace("o", "0", 1).replace("i", "1", 1)
            return f"{w}{sign}{self.chars(alnum, 5, 5)}"
        if kind == 3:
            s = self.chars(alnum, 10, 18)
            k = r.randrange(2, len(s) - 2)
            return s[:k] + sign + s[k:]
        if kind == 4:
            return self.chars("0123456789abcdef", *[r.choice([32, 40, 48, 64])] * 2)
        if kind == 5:
            return self.chars(alnum + "+/", 42, 43) + "="
        if kind == 6:
            return self.chars(alnum, 20, 46)
        if kind == 7:
            return r.choice(["ghp_", "glpat-", "sk_live_", "sk-", "sk-proj-", "AIza", "npm_", "hf_"]) + self.chars(alnum, 18, 44)
        if kind == 8:
            return f"xoxb-{self.chars('0123456789', 11, 11)}-{self.chars(alnum, 24, 24)}"
        if kind == 9:
            return f"{self.chars('abcdefghijklmnopqrstuvwxyz', 3, 3)}_{r.choice(['live', 'key', 'pat', 'prod'])}_{self.chars(alnum, 24, 24)}"
        if kind == 10:
            return f"eyJ{self.chars(alnum, 30, 36)}.eyJ{self.chars(alnum, 40, 60)}.{self.chars(alnum + '-_', 43, 43)}"
        if kind == 11:
            return "AKIA" + self.chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 16)
        if kind == 12:
            return self.chars(alnum + "-_", 14, 24).strip("-_") + "7"
        return f"{self.word().title()}{sign}{r.randrange(100, 9999)}{self.word()}"

    def decoy(self):
        r, up = self.r, self.ident().upper().replace("-", "_")
        return r.choice(
            [
                "${" + up + "}", "$" + up, "{{ vault." + self.word() + ".x }}", "x" * r.randint(8, 24), "*" * r.randint(3, 12),
                "changeme", "REPLACE_ME", "<redacted>", "", "null", f"example-{self.word()}-token", f"<your-{self.word()}-here>",
                f"env:{up}", f"vault:{self.ident()}", f"file:///etc/{self.word()}/secret", f"/run/secrets/{self.ident()}",
                "your-token-here", "none", "dummy", "placeholder", r.choice(_STATES), r.choice(_STATES),
            ]
        )

    def quoted(self, v):
        q = self.r.choice(['"', '"', "'", "'", "`"])
        return f"{q}{v}{q}"

    def assign(self, name, value, bare=True):
        r = self.r
        v = value if bare and r.random() < 0.35 else self.quoted(value)
        lead = r.choice(["", "", "  ", "    ", "\t", "+", "+  ", "- ", "export ", "const ", "var ", "self."])
        form = r.choice(["{n}={v}", "{n} = {v}", "{n}: {v}", '"{n}": {q}', "{n}: {v},", "{n} := {v}", '{l}["{n}"] = {q}', "{n}={v}  # rotate me"])
        return lead + form.format(n=name, v=v, q=self.quoted(value), l=self.word())

    def plain_password(self):
        """A value that only its name tells to be a password."""
        r, w = self.r, self.r.choice(_PLAIN_PASSWORDS)
        w = r.choice([w, w, w + str(r.randrange(1000)), w.title() + str(r.randrange(100)), w[:3], str(r.randrange(1000, 10**6))])
        name = self.name(r.choice([n for n in _CREDENTIALS if name_class(n) == "pw"]))
        v = w if r.random() < 0.6 else self.quoted(w)
        if r.random() < 0.1:
            w = f"{w}{r.randrange(10)}"
            return f"mysql -u {self.word()} -p{w} {self.word()}", w
        return r.choice(["", "  ", "export ", "+"]) + r.choice([f"{name}: {v}", f"{name}={v}", f"{name} = {self.quoted(w)}", f'"{name}": "{w}"', f"{name}: {v}  # old"]), w

    @staticmethod
    def tells(s):
        return shape(s) in ("known", "vendor", "jwt")

    def self_telling(self):
        """A literal that needs no name."""
        r, s = self.r, ""
        while not self.tells(s):
            s = self.secret()
        return r.choice(
            [
                f"{self.word().upper()}={s}", s, f'{self.word()} = "{s}"', f"{self.word()}: {s}", f"use {s} for {self.ident()}",
                f'connect("{self.ident()}", "{s}")', f"{self.ident()} {s}", f"  '{s}',", f"echo {s} | {self.word()}", f'{{"{self.word()}": "{s}"}}',
            ]
        ), s

    def several_lines(self):
        """(tokens, labels) of a literal alone on its line, behind the line that opens it."""
        r, s = self.r, self.secret()
        good = r.random() < 0.6
        name = self.name(r.choice(_PLURALS + _CREDENTIALS if good or r.random() < 0.5 else _SETTINGS + _OTHERS))
        dead = [self.decoy() or "none", self.ident(), self.ident()]
        if name_class(name) not in ("pw", "cred", "many"):
            dead.append(self.chars("0123456789abcdef", 40, 64))
        value = s if good else r.choice(dead)
        head = lex(r.choice([f"{name} = [", f"{name}:", f"  {name}: [", f"{name} = \\", f'"{name}": [', f"{name} = (", f"{name}: |", f"{name}: >"]))
        n = max((t.end for t in head), default=0) + 1
        tail = lex(r.choice([f"  {self.quoted(value)},", f"    {value}", f"  - {value}", f"  {self.quoted(value)}", f"- {self.quoted(value)}"]), n)
        if name_class(name) not in ("pw", "cred", "many"):
            head = []  # the reader does not join such lines
        live = value == s and (name_class(name) in ("pw", "cred", "many") or self.tells(s))
        tokens = head[-5:] + tail
        return tokens, [int(live and t.text == s and t.start >= n) for t in tokens]

    def unnamed(self):
        """Literals of every form that no name makes a credential."""
        r = self.r
        alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        v = r.choice(
            [
                self.chars("0123456789abcdef", 7, 64), self.chars(alnum + "+/", 20, 76), self.chars(alnum + r.choice(["+/", "-_"]), 500, 900), self.ident() + str(r.randrange(99)),
                f"{self.word().title()}_{r.randrange(999)}{self.word()}", f"{self.word()}.{self.word()}{r.randrange(10, 99)}", self.chars(alnum, 8, 16),
                f"2026-0{r.randrange(1, 9)}-11T0{r.randrange(9)}:20:39", f"{r.randrange(99)}.{r.randrange(99)}", f"{self.word()}@{self.word()}.test", self.word() + "!",
                f"r{r.randrange(9)}ck{self.word()[:3]}-{self.chars(alnum, 5, 5)}", "é" + self.word(), "ok", "-x", self.chars("0123456789", 1, 12), f"src/{self.word()}/{self.ident()}.py",
            ]
        )
        return r.choice([f"git show {v}", v, f"{self.word()} = {self.quoted(v)}", f"{self.word()}: {v}", f"see {v} for {self.ident()}", f'{{"{self.word()}": "{v}"}}', f"{self.word().upper()}={v}"])

    def long_value(self):
        """A literal above the limit for looking at its parts, with a credential's name or another."""
        r, good = self.r, self.r.random() < 0.5
        alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        s = self.chars(r.choice([alnum, alnum + "+/", alnum + "-_", "0123456789abcdef"]), LONG + 1, 2 * LONG)
        name = self.name(r.choice([n for n in _CREDENTIALS if name_class(n) != "setting"] if good else _OTHERS + _SETTINGS + _CHECKSUMS + ["data", "payload", "public_key"]))
        return f"{name}{r.choice([' = ', ': ', '='])}{self.quoted(s)}", s if good else None

    def positive(self):
        r, s = self.r, self.secret()
        cred, host = self.name(r.choice(_CREDENTIALS)), f"{self.ident()}.{r.choice(['test', 'example', 'internal', 'corp.example'])}"
        k = r.randrange(25)
        if k < 9:
            return self.assign(cred, s), s
        line = [
            lambda: f"curl -s -H {self.quoted(r.choice(['Authorization: Bearer ', 'X-Api-Key: ', 'X-Auth-Token: ', 'Authorization: Basic ']) + s)} https://{host}/v1/{self.word()}",
            lambda: f'"headers": {{"Authorization": "{r.choice(["Bearer", "Basic", "token"])} {s}"}}',
            lambda: f'h["Authorization"] = "{r.choice(["Bearer", "Basic", "token"])} {s}"',
            lambda: f"Authorization: {r.choice(['Bearer', 'Basic', 'token'])} {s}",
            lambda: f"{r.choice(_PLURALS)} = [{self.quoted(s)}]",
            lambda: f'req.Header.Set("{r.choice(["X-Auth-Token", "X-Api-Key", "Authorization"])}", "{s}")',
            lambda: f'opts = append(opts, With("{cred}", "{s}"))',
            lambda: f"kw.setdefault('{cred}', {self.quoted(s)})",
            lambda: f'client.login("{self.ident()}", "{s}")',
            lambda: f"docker login -u {self.word()} -p {s} {host}",
            lambda: f"PGPASSWORD={s} psql -h {host} -U {self.word()} -d {self.word()}",
            lambda: f"./{self.ident()} --{r.choice(['secret', 'token', 'auth-token', 'admin-pass', 'password'])}{r.choice(['=', ' '])}{s} --retries {r.randrange(9)}",
            lambda: f"The {self.ident()} {r.choice(['password', 'token', 'passphrase', 'secret'])} is {s} until {r.choice(['friday', 'monday', 'then'])}",
            lambda: f"// {cred} was \"{s}\" before the move",
            lambda: f"{r.choice(['api key', 'password', 'token', 'secret', 'access token'])} {s}",
            lambda: f"export {cred.upper()}={s} && make {self.word()}",
            lambda: f'{{"shell": "{self.word()}", "exit_code": 0, "env": {{"{cred.upper()}": "{s}", "LANG": "C"}}}}',
            lambda: f'{{"path": "src/{self.word()}/{self.ident()}.py", "size": {r.randrange(9999)}, "cmd": "{cred.upper()}={s} ./run.sh"}}',
            lambda: f'{{"tool": "recall", "cmd": "curl -H \\"X-Api-Key: {s}\\" https://{host}/v2"}}',
            lambda: f'{{"tool": "recall", "headers": ["Accept: */*", "Authorization: Bearer {s}"]}}',
            lambda: f'{{"repo": "{self.ident()}", "cmd": "deploy --token {s} --dry-run"}}',
            lambda: f'run({cred}="{s}")',
            lambda: f"mysql -h {host} -u {self.word()} -p{s} {self.word()}",
            lambda: f"{r.choice(['mysql', 'mysqldump', 'mariadb'])} -u {self.word()} -p{s} {self.word()}",
            lambda: f"{r.choice(['login', 'password', 'key'])} for {self.ident()} {r.choice(['stays', 'is now', 'remains'])} {s} for now",
            lambda: f"sshpass -p {self.quoted(s)} ssh ops@{host}",
            lambda: f"curl -u {self.word()}:{s} https://{host}",
        ]
        if k < 22:
            return r.choice(line)(), s
        s = s.replace("/", "x").replace("@", "x")
        url = f"{r.choice(['postgresql', 'redis', 'amqp', 'mysql', 'https'])}://{self.ident()}:{s}@{host}{r.choice(['', ':5432'])}/{self.word()}"
        return r.choice([f"dsn: {url}", f"export {self.word().upper()}_URL={url}", f"{self.word()}_url={url}", f'conn = connect("{url}")', f"{self.word().upper()}_URL={url}", f"git clone {url}.git", f'"remote": "{url}.git"']), s

    def negative(self):
        r, cred = self.r, self.name(self.r.choice(_CREDENTIALS))
        k = r.randrange(16)
        if k < 5:
            return self.assign(cred, self.decoy())
        if k == 5:
            v = r.choice([str(r.randrange(9999)), self.ident(), f"{self.ident()}-tls", f"/run/secrets/{self.ident()}", f"https://{self.word()}.example/x", f"{self.ident()}:{self.word()}:{r.randrange(99)}", f"{self.word()}/{self.ident()}/{r.randrange(99)}"])
            return self.assign(self.name(r.choice(_SETTINGS)), v)
        if k == 6:
            v = r.choice([self.chars("0123456789abcdef", *[r.choice([32, 40, 64])] * 2), f"sha256:{self.chars('0123456789abcdef', 64, 64)}"])
            return self.assign(self.name(r.choice(_CHECKSUMS)), v) + r.choice(["", " # token check", "  # key file"])
        if k == 7:
            call = r.choice([f'readSecret("/run/secrets/{self.ident()}")', f'get_{r.choice(_CREDENTIALS)}("{self.ident()}")', f'os.environ["{cred.upper()}"]', f"process.env.{self.ident().upper()}", f'os.getenv("{cred.upper()}")', f'load_key("{self.ident()}")'])
            return f"{r.choice(['', '  ', 'const '])}{cred}{r.choice([' = ', ': ', '='])}{call}"
        if k == 8:
            return self.assign(self.name(r.choice(["public_key", "ssh_public_key", "host_key"])), f"ssh-ed25519 AAAAC3{self.chars('ABCDEFabcdef0123456789+/', 50, 60)} ops@{self.ident()}.test")
        if k == 9:
            return r.choice(
                [
                    f"Passwords for {self.ident()} must be rotated, the token lives in the vault.",
                    f"psql -h {self.ident()}.example -U {self.word()} --password",
                    f"echo ${self.word().upper()}_TOKEN",
                    f'curl -H "Authorization: Bearer $TOKEN" https://{self.ident()}.test',
                    f"The {self.ident()} token is stored in {self.ident()} and the key is rotated by {self.ident()}.",
                    f"We moved the secret from {self.ident()} to {self.ident()}, because the auth check took {r.randrange(9999)} ms.",
                    f"login to {self.ident()} with your own key, see docs/{self.word()}/{self.ident()}.md",
                    f"{self.ident()} reads the password file in src/{self.word()}/{self.ident()}.yaml after {r.randrange(999)} tries",
                    f"git checkout -b {self.ident()}-auth-token",
                    f"The tokens of {self.ident()} and the keys of {self.ident()} passed {r.randrange(999)} checks before the authors signed {self.ident()}{r.randrange(99)}.",
                    f"func (a *{self.word().title()}) {self.word()}Key(ctx context.Context, {self.word()}Pass int) error {{",
                    f"for key, {self.word()} in {self.ident()}.items():",
                    f"if token == {self.word()}.{self.word()}{r.randrange(99)} && {self.word()} != nil {{",
                    f"{self.word()}({self.ident()}.password, {self.word()}.{self.word()})",
                    f"make {self.ident()} KEY={self.ident()}",
                    f"mysql -h {self.ident()}.test -u {self.word()} -p {self.word()}",
                    f"mkdir -p {self.word()}/{self.ident()} && cp -p {self.ident()} {self.word()}",
                    f"docker run -p {r.randrange(9999)}:{r.randrange(9999)} -u {self.word()} {self.ident()}",
                    f"docker run -p{r.randrange(1000, 9999)}:{r.randrange(1000, 9999)} -u {self.word()} {self.ident()}",
                    f"ssh -p {r.randrange(9999)} {self.word()}@{self.ident()}.test",
                    f"Decided to keep the key cache of {self.ident()} local and let {self.ident()} publish only {r.randrange(99999)} tokens per cycle.",
                    f"Encoding of {self.ident()} takes {r.randrange(9999)} tokens longer than {self.ident()} whenever the token file lib/{self.word()}/{self.ident()}.toml is open.",
                ]
            )
        if k == 10:
            return f'dsn = "postgres://{self.word()}:${{DB_PASS}}@{self.ident()}.test/{self.word()}"'
        if k == 11:
            return f'{{"shell": "{self.word()}", "exit_code": {r.randrange(99)}, "{cred}": "{self.decoy()}"}}'
        if k == 12:
            return f'{{"path": "lib/{self.word()}/{self.ident()}.rs", "size": {r.randrange(99999)}, "{r.choice(["sha", "secret_ref", "token", "key_id"])}": "{self.decoy()}"}}'
        if k == 13:
            return self.assign(self.name(r.choice(_OTHERS)), self.ident()) + r.choice(["", "  # no secret", "  # auth"])
        if k == 14:
            u = self.chars("0123456789abcdef", 32, 32)
            return self.assign(self.name(r.choice(["key_id", "token_id", "request_id", "trace_id", "client_id"])), f"{u[:8]}-{u[8:12]}-{u[12:16]}-{u[16:20]}-{u[20:]}")
        return f'{self.word()}({self.ident()}, "{self.ident()}")  # {r.choice(["token", "key", "auth"])} of {self.ident()}'

    def key_block(self):
        r = self.r
        private = r.random() < 0.5
        label = r.choice(["RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY"] if private else ["CERTIFICATE", "PUBLIC KEY", "RSA PUBLIC KEY"])
        body = "\n".join(self.chars("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 60, 64) for _ in range(r.randint(4, 12)))
        lead = r.choice([f'{self.name("private_key")} = """', f"{self.word()}_pem = `", "", "tls_key: |", '"key_material": "', f'{self.name(r.choice(["cert", "public_key"]))}: "'])
        tokens = lex(lead)
        at = len(lead)
        text = f"-----BEGIN {label}-----\n{body}\n-----END {label}-----"
        tokens.append(Token(text, at, at + len(text), "pem"))
        return tokens, [int(private and t.kind == "pem") for t in tokens]

    def example(self):
        """(tokens, labels) of a generated line; the secret is exactly one token."""
        k = self.r.random()
        if k < 0.06:
            return self.key_block()
        if k < 0.11:
            return self.several_lines()
        if k < 0.13:
            line, secret = self.long_value()
            tokens = lex(line)
            return tokens, [int(t.text == secret) for t in tokens]
        if k < 0.18:
            return self.plain(self.unnamed())
        if k < 0.55:
            line, secret = self.positive() if k < 0.47 else self.plain_password() if k < 0.51 else self.self_telling()
            tokens = lex(line)
            labels = [int(t.text == secret) for t in tokens]
            return tokens, labels
        return self.plain(self.negative())

    @staticmethod
    def plain(line):
        tokens = lex(line)
        return tokens, [0] * len(tokens)


def examples(n: int, seed: int) -> list[tuple]:
    """``n`` generated lines; lines whose secret the lexer does not leave whole are left out."""
    maker, out = Maker(seed), []
    while len(out) < n:
        positive = maker.example()
        if positive[0]:
            out.append(positive)
    return out


def train(n: int = LINES, passes: int = PASSES, seed: int = 11) -> tuple[dict[str, float], tuple]:
    """(weights, transitions) for ``Field``."""
    data = examples(n, seed)
    vocab: dict[str, int] = {}
    width = max(len(t) for t, _ in data)
    rows, cols, ids = [], [], []
    gold = np.zeros((n, width), np.int64)
    mask = np.zeros((n, width), bool)
    for k, (tokens, labels) in enumerate(data):
        mask[k, : len(tokens)], gold[k, : len(tokens)] = True, labels
        for i, fs in enumerate(features(tokens)):
            for f in fs:
                rows.append(k)
                cols.append(i)
                ids.append(vocab.setdefault(f, len(vocab)))
    place = np.array(rows) * width + np.array(cols)
    ids = np.array(ids)
    w, trans = np.zeros(len(vocab)), np.zeros(5)
    params = [w, trans]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    last = mask.sum(axis=1) - 1
    bare = np.array([i for f, i in vocab.items() if f.startswith("bare=")])
    for step in range(1, passes + 1):
        e = np.bincount(place, w[ids], n * width).reshape(n, width)
        e = np.stack([np.zeros_like(e), e], axis=2)
        start = np.array([0.0, trans[0]])
        t = trans[1:].reshape(2, 2)
        alpha = np.zeros((n, width, 2))
        alpha[:, 0] = start + e[:, 0]
        for i in range(1, width):
            a = np.logaddexp(alpha[:, i - 1, :1] + t[0], alpha[:, i - 1, 1:] + t[1]) + e[:, i]
            alpha[:, i] = np.where(mask[:, i, None], a, alpha[:, i - 1])
        z = np.logaddexp(*alpha[np.arange(n), last].T)
        beta = np.zeros((n, width, 2))
        g_t = np.zeros((2, 2))
        for i in range(width - 2, -1, -1):
            nxt = e[:, i + 1] + beta[:, i + 1]
            b = np.logaddexp(t[None, :, 0] + nxt[:, :1], t[None, :, 1] + nxt[:, 1:])
            on = mask[:, i + 1]
            beta[:, i] = np.where(on[:, None], b, 0)
            pair = np.exp(alpha[:, i, :, None] + t[None] + nxt[:, None, :] - z[:, None, None])[on]
            g_t += pair.sum(axis=0)
            np.add.at(g_t, (gold[on, i], gold[on, i + 1]), -1)
        p1 = np.where(mask, np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]), 0)
        diff = p1 - gold * mask
        g_w = np.bincount(ids, diff.reshape(-1)[place], len(vocab)) / n + 2e-5 * w
        g_s = np.concatenate([[diff[:, 0].sum()], g_t.reshape(-1)]) / n + 2e-5 * trans
        for p, g, a, b in zip(params, (g_w, g_s), m1, m2):
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            p -= 0.25 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-9)
        w[bare] = np.minimum(w[bare], -1.0)  # a bare form never tells by itself
    return {f: float(w[i]) for f, i in vocab.items() if abs(w[i]) > 1e-3}, tuple(float(x) for x in trans)
