"""Signature rules of licences over normalized words: what a rule is, and the ordered list of them.

Patterns match words in lower case with one space between them ("GPL-3.0-only" reads "gpl 3 0 only"). Names are written
by hand, one for each way to write a licence; of each come a bare rule and one for notices ("released under the ..."), and
of each label a rule for its machine-readable tag. Rules of wording are the first words of licence texts."""

from __future__ import annotations

from dataclasses import dataclass

#: Tiers, strongest first: denials take what they contain, then tags and addresses, notices and wordings, names with a
#: version, names without; with the confidence of what each finds.
DENIAL, TAG, NOTICE, NAME, FAMILY = range(5)
CONFIDENCE = (0.0, 1.0, 0.95, 0.8, 0.6)


@dataclass(frozen=True)
class Rule:
    keyword: str  # a word without which the pattern can't match
    pattern: str
    label: str
    tier: int
    base: bool = False


def _v(major: int, minor: int = 0) -> str:
    """A version: 2, 2 0, v2, v 2 0, version 2 0."""
    return rf"(?:version |v |v)?{major}" + (f" {minor}" if minor else "(?: 0)?")


_GPL, _LGPL, _AGPL, _FDL = r"(?:gnu )?(?:gpl|general public licen[cs]e)", r"(?:gnu )?(?:lgpl|(?:lesser|library) (?:gpl|general public licen[cs]e))", r"(?:gnu )?(?:agpl|affero (?:gpl|general public licen[cs]e))", r"(?:gnu )?(?:fdl|gfdl|free documentation licen[cs]e)"
_LATER = r"(?: or (?:any )?later(?: version)?| only)?"

#: (label, keywords, pattern); of several keywords each makes a rule of its own.
VERSIONED = [
    ("apache-1.0", "apache", rf"apache(?: software)?(?: licen[cs]e)? {_v(1)}"),
    ("apache-1.1", "apache", rf"apache(?: software)?(?: licen[cs]e)? {_v(1, 1)}"),
    ("apache-2.0", "apache", rf"apache(?: software)?(?: licen[cs]e)? {_v(2)}"),
    ("apache-2.0", "asl", r"asl 2(?: 0)?"),
    ("gpl-1.0", "gpl license licence", rf"{_GPL} {_v(1)}{_LATER}"),
    ("gpl-2.0", "gpl license licence", rf"{_GPL} {_v(2)}{_LATER}"),
    ("gpl-3.0", "gpl license licence", rf"{_GPL} {_v(3)}{_LATER}"),
    ("gpl-2.0", "gplv2", r"(?:gnu )?gplv2(?: 0)?"),
    ("gpl-3.0", "gplv3", r"(?:gnu )?gplv3(?: 0)?"),
    ("lgpl-2.0", "lgpl license licence", rf"{_LGPL} {_v(2)}{_LATER}"),
    ("lgpl-2.1", "lgpl license licence", rf"{_LGPL} {_v(2, 1)}{_LATER}"),
    ("lgpl-3.0", "lgpl license licence", rf"{_LGPL} {_v(3)}{_LATER}"),
    ("lgpl-2.1", "lgplv2", r"(?:gnu )?lgplv2 1"),
    ("lgpl-3.0", "lgplv3", r"(?:gnu )?lgplv3(?: 0)?"),
    ("agpl-1.0", "agpl license licence", rf"{_AGPL} {_v(1)}{_LATER}"),
    ("agpl-3.0", "agpl license licence", rf"{_AGPL} {_v(3)}{_LATER}"),
    ("agpl-3.0", "agplv3", r"(?:gnu )?agplv3(?: 0)?"),
    ("gfdl-1.1", "gfdl fdl documentation", rf"{_FDL} {_v(1, 1)}{_LATER}"),
    ("gfdl-1.2", "gfdl fdl documentation", rf"{_FDL} {_v(1, 2)}{_LATER}"),
    ("gfdl-1.3", "gfdl fdl documentation", rf"{_FDL} {_v(1, 3)}{_LATER}"),
    ("mpl-1.0", "mozilla", rf"mozilla public licen[cs]e {_v(1)}"),
    ("mpl-1.1", "mozilla", rf"mozilla public licen[cs]e {_v(1, 1)}"),
    ("mpl-2.0", "mozilla", rf"mozilla public licen[cs]e {_v(2)}"),
    ("mpl-1.1", "mpl", rf"mpl {_v(1, 1)}"),
    ("mpl-2.0", "mpl", rf"mpl {_v(2)}"),
    ("epl-1.0", "eclipse", rf"eclipse public licen[cs]e {_v(1)}"),
    ("epl-2.0", "eclipse", rf"eclipse public licen[cs]e {_v(2)}"),
    ("epl-1.0", "epl", rf"epl {_v(1)}"),
    ("epl-2.0", "epl", rf"epl {_v(2)}"),
    ("edl-1.0", "eclipse", rf"eclipse distribution licen[cs]e {_v(1)}"),
    ("cpl-1.0", "common", rf"common public licen[cs]e {_v(1)}"),
    ("cddl-1.0", "cddl", rf"cddl {_v(1)}"),
    ("cddl-1.1", "cddl", rf"cddl {_v(1, 1)}"),
    ("cddl-1.0", "common", rf"common development and distribution licen[cs]e {_v(1)}"),
    ("cddl-1.1", "common", rf"common development and distribution licen[cs]e {_v(1, 1)}"),
    ("bsd-4-clause", "bsd", r"(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd|old bsd)(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", r"(?:bsd (?:3|three) clause|(?:3|three) clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?"),
    ("bsd-2-clause", "bsd", r"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd|freebsd)(?: licen[cs]e)"),
    ("bsd-2-clause", "bsd", r"(?:bsd (?:2|two) clause|(?:2|two) clause bsd)"),
    ("0bsd", "bsd", r"(?:zero|0) clause bsd(?: licen[cs]e)?"),
    ("0bsd", "0bsd", r"0bsd(?: licen[cs]e)?"),
    ("afl-2.1", "academic", rf"academic free licen[cs]e {_v(2, 1)}"),
    ("afl-3.0", "academic", rf"academic free licen[cs]e {_v(3)}"),
    ("artistic-1.0", "artistic", rf"artistic licen[cs]e {_v(1)}"),
    ("artistic-2.0", "artistic", rf"artistic licen[cs]e {_v(2)}"),
    ("bsl-1.0", "boost", rf"boost software licen[cs]e {_v(1)}"),
    ("busl-1.1", "business", rf"business source licen[cs]e {_v(1, 1)}"),
    ("cecill-2.0", "cecill", rf"cecill {_v(2)}"),
    ("cecill-2.1", "cecill", rf"cecill {_v(2, 1)}"),
    ("ecl-2.0", "educational", rf"educational community licen[cs]e {_v(2)}"),
    ("eupl-1.1", "eupl", rf"eupl {_v(1, 1)}"),
    ("eupl-1.2", "eupl", rf"eupl {_v(1, 2)}"),
    ("eupl-1.2", "european", rf"european union public licen[cs]e {_v(1, 2)}"),
    ("ipl-1.0", "ibm", rf"ibm public licen[cs]e {_v(1)}"),
    ("lppl-1.3", "lppl", rf"lppl {_v(1, 3)}c?"),
    ("lppl-1.3", "latex", rf"latex project public licen[cs]e {_v(1, 3)}c?"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e"),
    ("npl-1.1", "netscape", rf"netscape public licen[cs]e {_v(1, 1)}"),
    ("odbl-1.0", "odbl", rf"odbl {_v(1)}"),
    ("odbl-1.0", "database", rf"open database licen[cs]e {_v(1)}"),
    ("odc-by-1.0", "commons", rf"open data commons attribution licen[cs]e {_v(1)}"),
    ("pddl-1.0", "pddl", rf"pddl {_v(1)}"),
    ("ofl-1.0", "sil", rf"sil open font licen[cs]e {_v(1)}"),
    ("ofl-1.1", "sil", rf"sil open font licen[cs]e {_v(1, 1)}"),
    ("osl-2.1", "open", rf"open software licen[cs]e {_v(2, 1)}"),
    ("osl-3.0", "open", rf"open software licen[cs]e {_v(3)}"),
    ("php-3.01", "php", r"php licen[cs]e (?:version |v )?3 01"),
    ("psf-2.0", "python", rf"python software foundation licen[cs]e {_v(2)}"),
    ("qpl-1.0", "public", rf"q public licen[cs]e {_v(1)}"),
    ("sspl-1.0", "server", rf"server side public licen[cs]e {_v(1)}"),
    ("upl-1.0", "universal", rf"universal permissive licen[cs]e {_v(1)}"),
    ("w3c", "w3c", r"w3c software (?:notice and )?licen[cs]e"),
    ("wtfpl", "wtfpl", r"wtfpl(?: version| v)?(?: 2)?"),
    ("zpl-2.1", "zope", rf"zope public licen[cs]e {_v(2, 1)}"),
    ("mulan-psl-2.0", "mulan", rf"mulan psl {_v(2)}"),
    ("cc0-1.0", "cc0", r"(?:creative commons )?cc0(?: 1(?: 0)?)?(?: universal)?"),
    ("cc0-1.0", "creative", r"creative commons zero(?: 1 0)?(?: universal)?"),
    ("cc-pdm-1.0", "creative", r"creative commons public domain mark(?: 1 0)?"),
    ("openrail-m", "openrail", r"(?:creativeml |bigscience )?openrail m(?: licen[cs]e)?"),
    ("rail", "rail", r"(?:responsible ai|rail) licen[cs]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
]
FAMILIES = [
    ("apache", "license", "apache license"),
    ("mit", "license", "mit license"),
    ("gpl", "license", "general public license"),
    ("apache", "licence", "apache(?: software)? licence"),
    ("apache", "license", "apache software license"),
    ("mit", "licence", "mit licence"),
    ("mit", "license", r"(?:mit (?:x11|expat|style|type)|expat) license"),
    ("x11", "x11", r"(?<!mit )x11 licen[cs]e"),
    ("mit-0", "attribution", "mit no attribution(?: licen[cs]e)?"),
    ("gpl", "licence", "general public licence"),
    ("gpl", "gpl", r"(?:gnu )?gpl(?: licen[cs]e)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?: licen[cs]e)?"),
    ("lgpl", "license licence", rf"{_LGPL}"),
    ("agpl", "agpl", r"(?:gnu )?agpl(?: licen[cs]e)?"),
    ("agpl", "affero", rf"{_AGPL}"),
    ("gfdl", "documentation", r"gnu free documentation licen[cs]e"),
    ("mpl", "mozilla", "mozilla public licen[cs]e"),
    ("epl", "eclipse", "eclipse public licen[cs]e"),
    ("cpl", "license licence", "common public licen[cs]e"),
    ("cddl", "common", "common development and distribution licen[cs]e"),
    ("bsd", "bsd", "bsd(?: style| type)? licen[cs]e"),
    ("isc", "isc", "isc licen[cs]e"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e"),
    ("libpng", "libpng", "(?<!zlib )libpng licen[cs]e"),
    ("artistic", "artistic", "artistic licen[cs]e"),
    ("boost", "boost", "boost(?: software)? licen[cs]e"),
    ("afl", "academic", "academic free licen[cs]e"),
    ("osl", "license licence", "open software licen[cs]e"),
    ("ofl", "license licence", "(?:sil )?open font licen[cs]e"),
    ("odbl", "license licence", "open database licen[cs]e"),
    ("eupl", "european", "european union public licen[cs]e"),
    ("cecill", "cecill", "cecill(?: [bc])? licen[cs]e"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e"),
    ("postgresql", "postgresql", "postgresql licen[cs]e"),
    ("psf", "python", "python(?: software foundation)? licen[cs]e"),
    ("php", "php", "php licen[cs]e"),
    ("ruby", "ruby", "ruby licen[cs]e"),
    ("openssl", "openssl", "openssl licen[cs]e"),
    ("curl", "curl", "curl licen[cs]e"),
    ("vim", "vim", "vim licen[cs]e"),
    ("ijg", "jpeg", "independent jpeg group licen[cs]e"),
    ("jpnic", "jpnic", "jpnic licen[cs]e"),
    ("sleepycat", "sleepycat", "sleepycat licen[cs]e"),
    ("beerware", "beerware", "beerware licen[cs]e"),
    ("beerware", "beer", "beer ware licen[cs]e"),
    ("wtfpl", "license", "do what the fuck you want to public license"),
    ("sspl", "server", "server side public licen[cs]e"),
    ("busl", "business", "business source licen[cs]e"),
    ("elastic", "elastic", "elastic licen[cs]e"),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|shield|strict|internal use|perimeter) licen[cs]e"),
    ("commons-clause", "clause", "commons clause(?: licen[cs]e condition)?"),
    ("cc", "creative", "creative commons(?: attribution)? licen[cs]e"),
]
#: First words of licence texts and addresses: (label, keyword, pattern).
WORDING = [
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", r"neither the name of(?: [^ ]+){1,12} may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("isc", "hereby", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "altered", "altered source versions must be plainly marked as such"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("gpl", "verbatim", "everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document"),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the licen[cs]e"),
    ("mpl-2.0", "mozilla", r"subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("boost", "boost", "distributed under the boost software licen[cs]e"),
    ("public-domain", "domain", r"(?:dedicated to|released into|placed in|(?:is|are) in) the public domain"),
    ("beerware", "beer", "you can buy me a beer in return"),
    ("gfdl", "invariant", "with no invariant sections no front cover texts and no back cover texts"),
    ("ofl", "font", "this font software is licensed under the sil open font licen[cs]e"),
]
ADDRESSES = [
    ("apache-2.0", "apache", r"apache org licenses license 2 0"),
    ("apache-1.1", "apache", r"apache org licenses license 1 1"),
    ("gpl-2.0", "gnu", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", "gnu", r"gnu org licenses gpl 3 0"),
    ("lgpl-2.1", "gnu", r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", "gnu", r"gnu org licenses lgpl 3 0"),
    ("agpl-3.0", "gnu", r"gnu org licenses agpl 3 0"),
    ("mpl-2.0", "mozilla", r"mozilla org mpl 2 0"),
    ("mit", "opensource", r"opensource org licenses? mit"),
    ("isc", "opensource", r"opensource org licenses? isc"),
    ("unlicense", "unlicense", r"unlicense org"),
    ("cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero 1 0"),
]
_CC = {"by": "attribution", "nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
_CC_KINDS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
_ENDS = r"(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?"
_UNDER = r"(?:licensed|relicensed|released|distributed|redistributed|published|available|provided|covered|issued|shared|usable) (?:to you )?(?:under|with)(?: the)?(?: terms(?: and conditions)? of)?(?: the)?(?: conditions of)?(?: the)? "
_DENIED = r"(?:not|never|isn t|aren t|wasn t|no longer|neither) (?:licensed|relicensed|released|distributed|published|available|covered) under(?: [^ ]+){1,5}"


def _words(label: str) -> str:
    return label.replace("-", " ").replace(".", " ")


def _creative_commons() -> tuple[list, list]:
    names, addresses = [], []
    for kind in _CC_KINDS:
        parts = kind.split("-")
        long = " ".join(_CC[p] for p in parts)
        for version in _CC_VERSIONS:
            label, v = f"cc-{kind}-{version}", _words(version)
            names += [(label, "cc", f"cc {_words(kind)} {v}{_ENDS}"), (label, "creative", f"creative commons (?:{long}|{_words(kind)}) {v}{_ENDS}")]
            addresses.append((label, "creativecommons", f"creativecommons org licenses {_words(kind)} {v}"))
        names.append((f"cc-{kind}", "creative", f"creative commons (?:{long}|{_words(kind)}){_ENDS}"))
    return names, addresses


def rules() -> list[Rule]:
    """All rules in their order, which decides between equal intervals of a tier."""
    names, addresses = _creative_commons()
    versioned = [*VERSIONED, *names]
    labels = list(dict.fromkeys(label for label, *_ in [*versioned, *FAMILIES]))
    out = [Rule("under", _DENIED, "", DENIAL)]
    out += [Rule("spdx", f"spdx license identifier {_words(label)}(?: only| or later)?", label, TAG) for label in labels]
    out += [Rule(k, p, label, TAG) for label, k, p in [*ADDRESSES, *addresses]]
    out += [Rule(k, p, label, NOTICE) for label, k, p in WORDING]
    out += [Rule(k, _UNDER + p, label, NOTICE) for label, ks, p in [*versioned, *FAMILIES] for k in ks.split()]
    out += [Rule(k, p, label, NAME) for label, ks, p in versioned for k in ks.split()]
    out += [Rule(k, p, label, FAMILY, base=at < 3) for at, (label, ks, p) in enumerate(FAMILIES) for k in ks.split()]
    return out
