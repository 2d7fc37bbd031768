"""A small labelled table for the personal-data model: short made-up sentences with their spans, from fixed rules."""

from __future__ import annotations

import random

KINDS = ("email", "ip", "card", "phone")


def labelled_examples(n: int = 700, seed: int = 17) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, [(kind, start, end)]) with n texts, about a third of them without personal data."""
    rng = random.Random(seed)
    pick = rng.choice
    digits = lambda k: "".join(pick("0123456789") for _ in range(k))
    name = lambda: pick(["ann", "bo.li", "carla", "d_fox", "eva.k", "joe", "info", "m.rossi"]) + pick(["", "", digits(2)])
    host = lambda: pick(["mail", "post", "example", "web", "corp", "uni-x"])
    top = lambda: pick(["com", "org", "net", "de", "fr"])
    group = lambda sep: sep.join(digits(4) for _ in range(4))
    made = {
        "email": [lambda: f"{name()}@{host()}.{top()}", lambda: f"{name()} (at) {host()} (dot) {top()}", lambda: f"{name()} [at] {host()} [dot] {top()}", lambda: f"{name()}(at){host()}.{top()}", lambda: f"{name()}[at]{host()}[dot]{top()}", lambda: f"{name()} (at) {host()}.{top()}", lambda: f"{name()} @ {host()}.{top()}"],
        "ip": [lambda: ".".join(str(rng.randint(1, 254)) for _ in range(4)), lambda: ".".join(str(rng.randint(100, 254)) for _ in range(4))],
        "card": [lambda: group(""), lambda: group(""), lambda: group(" "), lambda: group("-"), lambda: group("."), lambda: f"{digits(4)} {digits(6)} {digits(5)}"],
        "phone": [lambda: f"+{rng.randint(1, 99)} ({digits(3)}) 555-{digits(4)}", lambda: f"({digits(3)}) 555-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"+{rng.randint(1, 99)} {digits(3)} {digits(7)}", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}", lambda: f"+{rng.randint(1, 99)}-{digits(3)}-{digits(3)}-{digits(4)}"],
    }
    plain = [
        lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 9)}", lambda: f"version {rng.randint(1, 9)}.{rng.randint(0, 20)}", lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}", lambda: str(rng.randint(0, 99999)),
        lambda: f"{rng.randint(1990, 2030)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"${rng.randint(1, 999)}.{digits(2)}", lambda: "".join(pick("0123456789abcdef") for _ in range(pick([8, 32, 40, 64]))),
        lambda: f'token = "{"".join(pick("0123456789abcdef") for _ in range(40))}"', lambda: "AKIA" + "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), lambda: f"{rng.randint(1, 99)}%", lambda: f"{rng.randint(1, 400)}/{rng.randint(1, 400)}", lambda: f"{rng.randint(1, 20)}th",
        lambda: f"{pick(['password', 'secret', 'key'])}{pick('=:')}{''.join(pick('0123456789abcdef') for _ in range(18))}", lambda: f"#{rng.randint(1, 9999)}", lambda: f"{rng.randint(1, 99)},{digits(3)}", lambda: f"http://{host()}.{top()}/{rng.randint(1, 999)}", lambda: f"@{name()}", lambda: f"{rng.randint(1, 9)} @ ${rng.randint(1, 99)}", lambda: f"{pick('abc')}{rng.randint(1, 9)}", lambda: f"{rng.randint(1, 9)}-{rng.randint(1, 9)}", lambda: digits(pick([8, 20, 22])),
    ]
    word = lambda: pick("the of was erat ouin ein der qui des los para thing nten over call mail card from host order at to".split())
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(rng.randint(1, 4))), []
        for _ in range(rng.randint(1, 2)):
            kind = pick([*KINDS, "plain", "plain"])
            value = pick(made[kind] if kind in made else plain)()
            text += " " + pick(["", "", "", "(", '"']) if kind not in ("phone", "email") else " "
            if kind in made:
                spans.append((kind, len(text), len(text) + len(value)))
            text += value + pick(["", "", "", ".", ",", "!!", "%%%", '"', ")", " |"]) + " " + " ".join(word() for _ in range(rng.randint(1, 3)))
        out.append((text, spans))
    return out
