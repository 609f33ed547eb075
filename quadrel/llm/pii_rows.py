"""Made texts with known spans: one grammar for the trees, another one for their thresholds."""

from __future__ import annotations

import random
from collections.abc import Callable

NUM, LOW, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
UP, MARKS = LOW.upper(), "!#$%&*+-?@^_"
Pieces = list[tuple[str, str | None]]  # text, kind if it is personal or secret
Row = tuple[int, str, list[tuple[str, int, int]]]


class _Draw(random.Random):
    def some(self, *x: str) -> str:
        return self.choice(x)

    def chars(self, of: str, n: int, most: int = 0) -> str:
        return "".join(self.choices(of, k=self.randint(n, most) if most else n))

    def words(self, n: int, most: int) -> str:
        return " ".join(self.chars(LOW, 2, 9) for _ in range(self.randint(n, most)))

    def card(self, digits: int, right: bool = True) -> str:
        """A number whose check digit holds, or doesn't."""
        own = self.choice(NUM[1:]) + self.chars(NUM, digits - 2)
        total = sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(own)))
        return own + str((-total + (0 if right else self.randint(1, 9))) % 10)

    def mixed(self, n: int, most: int) -> str:
        """Letters of both cases, digits among them."""
        own = list(self.chars(LOW + UP + NUM, n, most))
        own[self.randrange(len(own))] = self.choice(NUM)
        own[0] = self.choice(UP)
        return "".join(own)

    def split(self, text: str, sizes: tuple[int, ...], by: str) -> str:
        out, at = [], 0
        for n in sizes:
            out.append(text[at : at + n])
            at += n
        return by.join([*out, *([text[at:]] if at < len(text) else [])])


def _fit_yes(d: _Draw) -> Pieces:
    return d.choice([
        lambda: [(d.some("password=", "pwd: ", "token = \"", "secret: ", "api_key=", "access_key: "), None), (d.some(d.chars(HEX, 16, 40), d.chars(LOW + NUM, 12, 32) + d.chars(NUM, 2)), "secret")],
        lambda: [(d.some("password=", "token = \"", "secret: ", "API_KEY=", "key: ", "auth_token='"), None), (d.some(d.mixed(13, 40), d.chars(LOW, 2) + d.chars(NUM, 10, 18) + d.chars(LOW + UP, 3, 8), d.chars(UP + NUM, 12, 30) + d.chars(NUM, 1), d.chars(LOW, 20, 70) + d.chars(NUM, 1, 3)), "secret")],
        lambda: [("AKIA" + d.chars(UP + NUM, 14) + d.chars(NUM, 2), "secret")],
        lambda: [(d.some("key ", "auth ", "bearer ", ""), None), (d.mixed(20, 44), "secret")],
        lambda: [(d.some("password=", "password: ", "pwd=", "passwd = ", "\"password\": \"", "pass: "), None), (d.some(d.chars(LOW, 4, 8) + d.chars(NUM, 1, 4) + d.chars(MARKS, 1), d.chars(LOW, 3, 7) + d.chars(NUM, 3, 4), d.chars(LOW, 2) + d.chars(LOW + NUM, 3, 7) + d.chars(NUM, 1, 2), d.mixed(7, 11), d.chars(LOW, 3, 6).title() + d.chars(MARKS, 1, 2) + d.chars(LOW + UP, 3, 5)), "password")],
        lambda: [(d.some("password=", "pwd=", "passphrase="), None), (d.some(d.chars(LOW, 8, 14), "-".join(d.chars(LOW, 3, 7) for _ in range(4)), d.chars(LOW, 4, 7).title() + d.chars(LOW, 4, 7).title()), "password")],
        lambda: [(d.some("phone ", "call ", "tel: ", "mobile ", ""), None), (f"({d.chars(NUM, 3)}) {d.chars(NUM, 3)}-{d.chars(NUM, 4)}", "number")],
        lambda: [(d.some("phone ", "call ", "tel. ", "fax "), None), (d.some("-", ".", " ").join((d.chars(NUM, 3), d.chars(NUM, 3), d.chars(NUM, 4))), "number")],
        lambda: [(f"{d.chars(NUM, 3)}-{d.chars(NUM, 3)}-{d.chars(NUM, 4)}", "number")],
        lambda: [(d.some("ssn ", "social security ", "SSN: "), None), (f"{d.chars(NUM, 3)}-{d.chars(NUM, 2)}-{d.chars(NUM, 4)}", "number")],
        lambda: [(d.some("iban ", "account ", "IBAN: ", ""), None), (d.some("DE", "FR", "GB", "ES") + d.chars(NUM, 2) + "".join(" " + d.chars(NUM, 4) for _ in range(4)) + " " + d.chars(NUM, 2), "iban")],
        lambda: [(d.some("iban ", "account "), None), (d.some("DE", "NL", "IT") + d.chars(NUM, 18, 22), "iban")],
        lambda: [(f"{d.chars(LOW, 3, 8)}.{d.chars(LOW, 2, 6)} {d.some('(at)', '[at]', '(AT)')} {d.chars(LOW, 4, 8)} {d.some('(dot)', '[dot]', '(DOT)')} {d.some('com', 'org', 'net')}", "contact")],
        lambda: [(":".join(d.chars(HEX, 4) for _ in range(8)), "ip6")],
        lambda: [(d.some("ip ", "from ", "address "), None), (f"2001:{d.chars(HEX, 3, 4)}:{d.chars(HEX, 4)}::{d.chars(HEX, 1, 4)}", "ip6")],
        lambda: [(d.some("amex ", "card ", "credit card: ", "visa "), None), (d.some(d.split(d.card(15), (4, 6), " "), d.card(15), d.card(13)), "card")],
        lambda: [(d.some("phone ", "call ", "tel "), None), (f"+{d.chars(NUM, 3)} {d.chars(NUM, 4)}", "phone")],
    ])()


def _fit_no(d: _Draw) -> Pieces:
    text = d.choice([
        lambda: d.some("commit ", "sha ", "id ", "") + d.chars(HEX, 40), lambda: d.some("order ", "part ", "isbn ", "") + d.chars(NUM, 12, 20),
        lambda: f"{d.chars(NUM, 4)}-{d.chars(NUM, 2)}-{d.chars(NUM, 2)}", lambda: f"{d.chars(LOW, 8)}-{d.chars(LOW, 6)}-{d.chars(NUM, 2)}", lambda: f"version {d.chars(NUM, 3)}.{d.chars(NUM, 3)}.{d.chars(NUM, 4)}",
        lambda: f"{d.chars(NUM, 3)} {d.chars(NUM, 3)} {d.chars(NUM, 4)}", lambda: f"/usr/lib/{d.chars(LOW, 8)}/{d.chars(LOW, 5)}{d.chars(NUM, 2)}", lambda: f"{d.chars(NUM, 3)}.{d.chars(NUM, 3)}.{d.chars(NUM, 3)}.{d.chars(NUM, 4)}",
        lambda: " ".join(d.chars(NUM, 4) for _ in range(4)), lambda: d.card(16, False), lambda: d.some("id ", "serial ", "") + d.card(15), lambda: f"+{d.chars(NUM, 2)} {d.chars(NUM, 3)}", lambda: f"+{d.chars(NUM, 3)} {d.chars(NUM, 4)} {d.some('points', 'units')}",
        lambda: f"{d.chars(LOW, 12)}{d.chars(NUM, 1)}", lambda: f"{d.some('page', 'fig', 'no')} {d.chars(NUM, 3)}-{d.chars(NUM, 2)}", lambda: f"{d.some('order', 'part', 'ref')} {d.chars(NUM, 3)}-{d.chars(NUM, 2)}-{d.chars(NUM, 4)}",
        lambda: f"{d.some('at', 'time', 'since')} {d.chars('01', 1)}{d.chars(NUM, 1)}:{d.chars('012345', 1)}{d.chars(NUM, 1)}:{d.chars('012345', 1)}{d.chars(NUM, 1)}", lambda: ":".join(d.chars(HEX, 2) for _ in range(6)), lambda: "::".join(d.chars("abcdef", 3, 4) for _ in range(3)),
        lambda: d.some("password: ", "token: ", "pass: ", "secret: ", "api_key: ") + d.some("required", "invalid", "missing", "expired", d.chars(LOW, 6, 10)), lambda: d.some("password=", "token=", "pwd=") + d.some("${PASSWORD}", "<secret>", "********", "xxxxxxxx", "$(vault)"),
        lambda: "-".join(d.chars(HEX, n) for n in (8, 4, 4, 4, 12)), lambda: f"{d.chars(LOW, 3, 6)} {d.some('(at)', '[at]')} {d.words(1, 1)}", lambda: f"{d.chars(UP, 2)}{d.chars(NUM, 2)} {d.chars(UP, 4)} {d.chars(UP, 4)} {d.chars(UP, 4)}",
        lambda: d.words(4, 8), lambda: f"{d.chars(LOW, 5)}_{d.chars(LOW, 6)}_{d.chars(NUM, 4)}", lambda: f"https://{d.chars(LOW, 7)}.org/{d.chars(LOW, 6)}/{d.chars(NUM, 6)}/{d.chars(LOW, 9)}",
    ])()
    return [(text, None)]


def _held_yes(d: _Draw) -> Pieces:
    return d.choice([
        lambda: [(d.some("export API_KEY=", "client secret: ", "Authorization token: ", "aws_secret_access_key = ", "auth token = '"), None), (d.some(d.chars(HEX, 24, 64), d.mixed(24, 40), d.chars(LOW, 2) + "_" + d.chars(NUM + LOW, 20, 30) + d.chars(NUM, 1)), "secret")],
        lambda: [(d.some("ghp_", "sk-", "xoxb-") + d.chars(LOW + UP + NUM, 24, 36) + d.chars(NUM, 1), "secret")],
        lambda: [(d.some("db_password: ", "root password=", "PASSWORD=", "login pass: ", "user_pwd="), None), (d.some(d.chars(LOW, 5, 7) + d.chars(NUM, 2, 3), d.chars(UP, 1) + d.chars(LOW, 4, 6) + "#" + d.chars(NUM, 2), d.mixed(8, 10)), "password")],
        lambda: [(d.some("db_passwd=", "wifi passphrase="), None), (d.some(d.chars(LOW, 9, 13), "-".join(d.chars(LOW, 4, 6) for _ in range(3))), "password")],
        lambda: [(d.some("reach me on my cell ", "please ring ", "office fax ", "telephone: "), None), (d.some(f"{d.chars(NUM, 3)}-{d.chars(NUM, 3)}-{d.chars(NUM, 4)}", f"({d.chars(NUM, 3)}) {d.chars(NUM, 3)}.{d.chars(NUM, 4)}"), "number")],
        lambda: [(d.some("his social is ", "SSN# ", "Social Security No. "), None), (f"{d.chars(NUM, 3)}-{d.chars(NUM, 2)}-{d.chars(NUM, 4)}", "number")],
        lambda: [(d.some("transfer to account ", "bank ", "pay into IBAN "), None), (d.some("AT", "CH", "BE", "PL", "SE") + d.chars(NUM, 2) + "".join(" " + d.chars(NUM, 4) for _ in range(d.randint(3, 5))), "iban")],
        lambda: [(d.some("write to ", "mail "), None), (f"{d.chars(LOW, 4, 9)} {d.some('[at]', '(at)', '( at )')} {d.chars(LOW, 4, 9)}{d.some('.', ' [dot] ', ' (dot) ')}{d.some('de', 'fr', 'io', 'example')}", "contact")],
        lambda: [(d.some("server ", "host at ", "logged in from "), None), (d.some(f"fe80::{d.chars(HEX, 4)}:{d.chars(HEX, 4)}:{d.chars(HEX, 4)}", f"2a0{d.chars(NUM, 1)}:{':'.join(d.chars(HEX, 1, 4) for _ in range(7))}"), "ip6")],
        lambda: [(d.some("my american express card ", "paid by visa ", "card no. "), None), (d.some(d.split(d.card(15), (4, 6), "-"), d.card(15), d.split(d.card(14), (4, 6), " ")), "card")],
        lambda: [(d.some("telephone ", "mobile: ", "call me at "), None), (f"+{d.chars(NUM, 3)}-{d.chars(NUM, 2)}-{d.chars(NUM, 2)}", "phone")],
    ])()


def _held_no(d: _Draw) -> Pieces:
    text = d.choice([
        lambda: d.some("md5 ", "revision ", "checksum ", "blob ") + d.chars(HEX, d.choice((32, 40))), lambda: d.some("invoice ", "serial no. ", "ean ", "ticket #") + d.chars(NUM, 10, 18), lambda: d.chars(NUM, 13, 16),
        lambda: f"{d.chars(LOW, 4, 8)}_v{d.chars(NUM, 1)}_{d.chars(LOW, 6)}_{d.chars(NUM, 2)}", lambda: f"build {d.chars(NUM, 3)}.{d.chars(NUM, 3)}.{d.chars(NUM, 4)}", lambda: f"{d.chars(NUM, 2)}/{d.chars(NUM, 2)}/{d.chars(NUM, 4)} {d.chars(NUM, 2)}:{d.chars(NUM, 2)}:{d.chars(NUM, 2)}",
        lambda: f"{d.chars(NUM, 3)} {d.chars(NUM, 3)} {d.chars(NUM, 4)} {d.some('people', 'euros', 'tons')}", lambda: f"/home/{d.chars(LOW, 6)}/{d.chars(LOW, 4)}{d.chars(NUM, 3)}/{d.chars(LOW, 7)}", lambda: "-".join(d.chars(HEX, n) for n in (8, 4, 4, 4, 12)),
        lambda: " ".join(d.chars(NUM, 5) for _ in range(3)), lambda: f"+{d.chars(NUM, 1)} {d.chars(NUM, 4)} {d.some('votes', 'percent')}", lambda: f"isbn {d.chars(NUM, 3)}-{d.chars(NUM, 1)}-{d.chars(NUM, 2)}-{d.chars(NUM, 6)}-{d.chars(NUM, 1)}",
        lambda: d.some("the password: ", "a token: ", "your secret: ") + d.words(3, 5), lambda: d.some("password=", "token=") + d.some("%s", "{{ token }}", "$TOKEN_ENV", "[redacted]", "<your-password>"), lambda: f"{d.some('mac', 'ether')} {':'.join(d.chars(HEX, 2) for _ in range(6))}",
        lambda: f"ratio {d.chars(NUM, 1)}:{d.chars(NUM, 1)}:{d.chars(NUM, 2)}", lambda: f"we meet (at) {d.words(1, 3)}", lambda: f"{d.chars(UP, 2)}{d.chars(NUM, 2)}-{d.chars(UP, 4)}-{d.chars(NUM, 4)}", lambda: f"{d.some('std', 'foo')}::{d.chars(LOW, 4)}::{d.chars(LOW, 5)}",
        lambda: f"www.{d.chars(LOW, 8)}.com/{d.chars(LOW, 10)}-{d.chars(NUM, 5)}", lambda: d.words(4, 8), lambda: f"{d.chars(NUM, 3)}-{d.chars(NUM, 2)}-{d.chars(NUM, 4)}-{d.chars(NUM, 2)}",
    ])()
    return [(text, None)]


def _rows(n: int, seed: int, yes: Callable[[_Draw], Pieces], no: Callable[[_Draw], Pieces]) -> list[Row]:
    d, out = _Draw(seed), []
    for k in range(n):
        text, spans = d.words(2, 8) + " ", []
        for piece, kind in (yes if k % 2 else no)(d):
            if kind:
                spans.append((kind, len(text), len(text) + len(piece)))
            text += piece
        quote = text[spans[-1][1] - 1] if spans else " "
        out.append((k, text + (quote if quote in "\"'" else "") + " " + d.words(2, 8), spans))
    return out


def fit_rows(n: int, seed: int) -> list[Row]:
    """Texts for the trees; every second one holds something personal or secret."""
    return _rows(n, seed, _fit_yes, _fit_no)


def held_rows(n: int, seed: int) -> list[Row]:
    """Texts with other cues, layouts and shapes than fit_rows has, for the thresholds."""
    return _rows(n, seed, _held_yes, _held_no)
