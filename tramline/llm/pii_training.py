"""A small labelled table for the personal-data tagger, made from templates by rule.

``{KIND:slot}`` marks a labelled run, ``{slot}`` an unlabelled filler.  The
sentences are drawn with a fixed seed, so the table is the same each time.
"""

from __future__ import annotations

import random
import re

KINDS = ("O", "name", "address", "secret", "id", "contact")
FIRST = "Anna James Maria Peter Sofia Lukas Emma Paul Clara Hugo Nina Oscar Laura Simon Elena Victor Marta Jonas Alice Daniel".split()
LAST = "Miller Schmidt Garcia Dubois Novak Larsen Rossi Keller Moreau Jensen Fischer Lopez Bennett Walsh Vogel Martin Costa Weber".split()
STREETS = "Oak Elm Mill Church Station Garden River Hill Park Maple".split()
WAYS = "Street Road Avenue Lane Drive Way".split()
TITLES = "Mr. Mrs. Ms. Dr. Prof. Herr Frau Madame Señor".split()
SYLLABLES = "an er in on at en ti es or te re th he of it is ou ed al ar st nd to nt ng se ha as le ve co me de hi ri ro ic ne ea ra ce li ch".split()
TEMPLATES = (
    "{w} {w} {w} {w} {w} {w} .",
    "{W} {w} {w} , {w} {w} {w} {w} {w} .",
    "{W} {w} {w} {w} . {W} {w} {w} {w} {w} .",
    "{w} {w} {num} {w} {w} , {num} {w} {w}",
    "{W} {w} {W} {w} {w} {W} {w} .",
    "{w} | {w} | {W} {w} | {w}",
    "{W} {W} {w} {w} . {W} .",
    "{W} . {W} {w} . {W} . {W} {w} {w} .",
    "{w} {w} . {W} , {W} {w} {w} . {W} .",
    "{W} . {W} . {W} . {W} . {W} {w} .",
    "{W} {W} {W} {W} {W} {W} {W} {w}",
    "{W} . {W} {W} {w} . {W} . {w} {w}",
    "{noise} {noise} {w} {noise} {noise} {noise} {noise}",
    "{noise} {w} {noise} {noise} {noise} {num} {noise}",
    "{shout} {shout} {shout} {shout} {shout} {shout}",
    "{w} {w} {shout} {W} {shout} {w} {noise}",
    "{w} {rare} {w} {w} {rare} {num} {w}",
    "{W} {w} {mail} {w} . {W} {w} {ip} {w} .",
    "{W} {w} in {year} {w} {w} {num} % {w} .",
    "{w} the {W} {W} , {W} {version} .",
    "{W} {version} {w} {w} {W} {num} .",
    "{title} {name:first} {name:last} {w} {w} {w} .",
    "{w} {w} {title} {name:last} {w} {w} .",
    "My name is {name:first} {name:last} {w} {w} .",
    "My name is {name:first} {name:last} and {w}",
    "name : {name:first} {name:last}",
    "Contact: {name:first} {name:last}",
    "Please contact {name:first} {name:last} {w} .",
    "{W} {w} {w} , contact {name:first} {name:last} .",
    "{w} {w} contact {name:first} {name:last} at {w} {w} .",
    "signed by {name:first} {name:last} .",
    "{w} lives at {address:no} {address:street} {address:way} {w} {w} .",
    "address : {address:no} {address:street} {address:way}",
    "{w} {w} {address:no} {address:street} {address:way} , {w} {w} .",
    'token = {secret:hex} {w}',
    "{w} api_key = {secret:key} {w} {w}",
    "password : {secret:pass} {w}",
    "{w} {secret:assigned} {w} {w}",
    "{w} {secret:assigned} .",
    "secret = {secret:key}",
    "{w} {w} {secret:upper} {w} {w}",
    "{W} {w} {secret:upper} . {W} {w}",
    "aws_access_key_id = {secret:upper} {w}",
    "{w} key {secret:key} {w} {w} .",
    "SSN {id:ssn} {w} {w} .",
    "{w} {w} {id:ssn} {w} .",
    "IBAN {id:iban} {w} .",
    "passport {id:passport} {w} {w} .",
    "{w} {w} {contact:user} [at] {contact:host} [dot] com {w}",
    "{w} {contact:user} (at) {contact:host} {w} .",
    "call {contact:tel} {w} {w} .",
    "phone : {contact:tel}",
    "{w} {w} tel. {contact:tel} {w} .",
    "{w} {w} {mail} {w} {w} .",
    "{w} {ip} {w} , {card} {w} +1 (555) {tel} {w} .",
)


def _fill(slot: str, rng: random.Random) -> str:
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
    mixed = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))
    return {
        "w": word,
        "W": lambda: word().capitalize(),
        "noise": lambda: (word() if rng.random() < 0.8 else word().capitalize()) + rng.choice(("", ".", ",")) + rng.choice("#%$&*~=+") * rng.randint(1, 3),
        "shout": lambda: word().upper() + rng.choice(("", "!", "!!", ".", ".!!", ",!!")),
        "rare": lambda: rng.choice((word() + "-" + word(), word() + "'" + word(), "|", "--", "(" + word() + ")", word() + digits(1), "http://" + word() + ".example.com/" + word(), word().capitalize() + word().capitalize(), "v" + digits(1) + "." + digits(1), digits(2) + ":" + digits(2), digits(1) + "," + digits(3))),
        "num": lambda: digits(rng.randint(1, 4)),
        "version": lambda: digits(1) + "." + digits(1),
        "year": lambda: "19" + digits(2),
        "title": lambda: rng.choice(TITLES),
        "first": lambda: rng.choice(FIRST),
        "last": lambda: rng.choice(LAST),
        "no": lambda: str(rng.randint(1, 999)),
        "street": lambda: rng.choice(STREETS),
        "way": lambda: rng.choice(WAYS),
        "hex": lambda: '"' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"',
        "key": lambda: rng.choice(("sk_live_", "AKIA", "ghp_", "")) + mixed(rng.randint(16, 36)),
        "pass": lambda: mixed(rng.randint(6, 9)) + digits(2) + rng.choice(("", "!", "#", "$")),
        "upper": lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(15)) + digits(1),
        "assigned": lambda: rng.choice(("api_key=", "token=", "password=", "secret=")) + rng.choice(("sk_live_", "ghp_", "")) + mixed(rng.randint(16, 36)),
        "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "iban": lambda: f"DE{digits(20)}",
        "passport": lambda: rng.choice("CFGHJK") + digits(8),
        "user": lambda: f"{word()}.{word()}",
        "host": word,
        "tel": lambda: f"{digits(3)}-{digits(3)}-{digits(4)}",
        "mail": lambda: f"{word()}@{word()}.example.com",
        "ip": lambda: ".".join(str(rng.randint(1, 254)) for _ in range(4)),
        "card": lambda: digits(16),
    }[slot]()


def labelled_sentences(n: int = 636, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """(words, kinds) of n sentences; templates take turns."""
    rng, out = random.Random(seed), []
    for k in range(n):
        words, kinds = [], []
        for part in TEMPLATES[k % len(TEMPLATES)].split():
            if m := re.fullmatch(r"\{(?:(\w+):)?(\w+)\}", part):
                words.append(_fill(m[2], rng))
                kinds.append(m[1] or "O")
            else:
                words.append(part)
                kinds.append("O")
        # punctuation that stands alone in a template hangs on the word before it, as in running text
        joined: list[str] = []
        tags: list[str] = []
        for w, t in zip(words, kinds, strict=True):
            if w in (".", ",", "%") and joined:
                joined[-1] += w
            else:
                joined.append(w)
                tags.append(t)
        out.append((joined, tags))
    return out
