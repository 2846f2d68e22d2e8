"""Detection against planted entities: what is found, what is left alone, and what surrogates keep."""

import ipaddress
import random
import re

import pytest

from pairfield.llm import pii as P
from pairfield.llm.queries import run_key, surrogate_key

KEY = b"a key of the tests"


def iban(rng):
    body = "WEST" + "".join(rng.choice("0123456789") for _ in range(14))
    return f"GB{98 - P.mod97(body + 'GB00'):02d}{body}"


def planted(rng):
    first = rng.choice("Yusuf Wei Priya Kwame Aoife Thandiwe Mehmet Linh Anna Robert".split())
    last = rng.choice("Khan Zhang Patel Mensah Byrne Dlamini Yilmaz Nguyen Weber Miller".split())
    name = f"{first} {last}"
    return [
        ("email", f"{first.lower()}.{last.lower()}{rng.randint(1, 99)}@example.org", "write to {}"),
        ("email", "иван@пример.рф", "пишите на {}"),
        ("iban", iban(rng), "account {}"),
        ("iban", " ".join(re.findall(".{1,4}", iban(rng))), "account {} please"),
        ("phone", f"{rng.randint(200, 999)} {rng.randint(100, 999)} {rng.randint(1000, 9999)}", "call {} now"),
        ("phone", f"(202) 555-{rng.randint(1000, 9999)}", "call {} now"),
        ("phone", f"+49 30 {rng.randint(100000, 999999)}", "tel {}"),
        ("phone", f"030 {rng.randint(1000000, 9999999)}", "tel {}"),
        ("ip", f"192.168.{rng.randint(0, 255)}.{rng.randint(0, 255)}", "host {} up"),
        ("ip", f"8.{rng.randint(0, 255)}.4.{rng.randint(0, 255)}", "host {} up"),
        ("ipv6", f"2001:db8::{rng.randint(4096, 65535):x}:{rng.randint(4096, 65535):x}", "host {} up"),
        ("person", name, "my name is {}."),
        ("person", name, "Dear {}, thanks"),
        ("person", name, "{} <someone@example.org>"),
        ("person", f"Anna {last}", "then {} spoke"),
    ]


def test_planted_entities_are_found():
    rng = random.Random(4)
    seen = hit = 0
    for _ in range(40):
        for kind, said, around in planted(rng):
            text = "Some words before. " + around.format(said) + " And more words."
            seen += 1
            hit += any(k == kind and text[a:b] == said for a, b, k, *_ in P.entities(text))
    assert hit / seen >= 0.98, hit / seen


@pytest.mark.parametrize(
    "text",
    [
        "Victor Hugo Avenue and Paul Robin Street", "at 12:30:45 the std::vector of a::b", "in 2001 200 3000 4000 and 100 200 3000", "The River Thames by Big Ben", "version 1.2.3 of 4.5.6.7.8",
        "my name is nothing", "dear reader, written by hand", "The number 020 is 7", "see page 212 of 555 and 1234",
    ],
)
def test_clean_text_is_left_alone(text):
    assert P.entities(text) == []


def test_surrogates_keep_what_makes_them_valid():
    rng = random.Random(5)
    for _ in range(200):
        found = iban(rng)
        made = P.surrogate(KEY, "iban", found)
        assert made[:2] == "GB" and P.mod97(made[4:] + made[:4]) == 1 and made != found
        spaced = " ".join(re.findall(".{1,4}", found))
        assert P.surrogate(KEY, "iban", spaced).replace(" ", "") == made
        area = f"{rng.randint(200, 999)}{rng.randint(1000000, 9999999)}"
        forms = [f"({area[:3]}) {area[3:6]}-{area[6:]}", f"+1 {area[:3]} {area[3:6]} {area[6:]}", f"{area[:3]} {area[3:6]} {area[6:]}"]
        digits = {"".join(c for c in P.surrogate(KEY, "phone", f) if c.isdigit())[-10:] for f in forms}
        assert len(digits) == 1 and digits.pop()[0] >= "2" and len({P.normal("phone", f) for f in forms}) == 1
        assert P.surrogate(KEY, "phone", f"030 {area[:7]}").startswith("0")
        address = str(ipaddress.IPv4Address(rng.getrandbits(32)))
        assert (P.network(int(ipaddress.IPv4Address(address))) is None) == (P.network(int(ipaddress.IPv4Address(P.surrogate(KEY, "ip", address)))) is None)
        assert ipaddress.IPv6Address(P.surrogate(KEY, "ipv6", f"2001:db8::{rng.randint(1, 65535):x}"))
    assert len({P.moved_address(KEY, f"10.0.{a}.{b}", 0) for a in range(40) for b in range(256)}) == 40 * 256
    assert re.fullmatch("[а-я]+@[а-я]+\\.рф", P.surrogate(KEY, "email", "иван@пример.рф"))


def test_a_cluster_needs_a_key():
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: None)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError, match="must hold a secret"):
        surrogate_key(Session)


def test_a_cluster_without_a_key_draws_one():
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: None)

        class sparkContext:
            master, applicationId = "spark://host:7077", "app-1"

    class Other(Session):
        class sparkContext:
            master, applicationId = "spark://host:7077", "app-2"

    class Named(Session):
        class conf:
            get = staticmethod(lambda name, default=None: "mine")

    assert run_key(Session) == run_key(Session) != run_key(Other)
    assert len(run_key(Session)) == 32 and run_key(Named) == b"mine"
