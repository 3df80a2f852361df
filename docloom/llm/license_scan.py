"""License scans by ordered signature rules.

Native: DataFrame functions only.

Some hundred licenses give several hundred regular expressions over words, in
four forms: an SPDX tag, a notice (`licensed under ...`), a title, and an address
or a sentence of the license itself. A rule is tried only on texts that pass one
cheap look for license words, and among them only where its own keyword stands.

Detections overlap: a notice holds a title, and the title of one license that of
another. A detection goes if another one of the same or a higher priority spans
all of its words; of equal spans and priorities the first rule in order stays.
For that, detections are put in order of start, longest first, and one running
maximum of the ends for each priority is compared with the own end, so a text
with very many detections costs a sort of them and no comparison of pairs.

Three base phrases are counted apart: their labels always stay.

A text is brought to the form ` word  word `: each word has a space on both
sides, so that matches which touch share no character. Spans count words. Only
the numbers of words before and in matches leave the scan, never the texts.

The score is the largest weight among the priorities of the detections that
stay, 0 where there are none.

Nulls and odd rows: a null text is empty; without words there is nothing to
find. Rows that repeat id and text are scanned each, and share their result. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import materialize, row_key, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Letters and digits of ASCII, and all beyond it: what is left between are the
# other ones, after A-Z are lower-cased.
WORD = "[\\p{Alnum}[^\\p{ASCII}]]+"
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

TAG, NOTICE, TITLE, FAMILY, HINT = 4, 3, 2, 1, 0
WEIGHTS = {TAG: 1.0, NOTICE: 0.9, TITLE: 0.7, FAMILY: 0.4, HINT: 0.2}

L, LATER = "licen[cs]e", "(?: or (?:any )?later(?: version)?| only)?"
GRANT = "(?:licen[cs]ed|released|distributed|available|provided|published|covered|offered|shared|used|redistributed) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"


def version(major: str, minor: str | None = "0", needed: bool = False) -> str:
    """A version number; a minor one of 0 may be left out."""
    tail = "" if minor is None else f" {minor}" if needed else f"(?: {minor})?"
    return f"(?:version |ver |v )?v?{major}{tail}"


# label, name in running text, SPDX tag, and sentences or addresses.
LICENSES: tuple[tuple[str, str, str, tuple[str, ...]], ...] = (
    ("mit", f"(?:mit|expat|mit x11|x11) {L}", "mit", ("permission is hereby granted free of charge to any person obtaining a copy", "opensource org licenses mit(?: license php)?", "the mit license mit")),
    ("mit-0", f"mit no attribution {L}", "mit 0", ("opensource org licenses mit 0",)),
    ("apache-2", f"(?:apache (?:software )?{L}|apl|asl) {version('2')}", "apache 2 0", ("apache org licenses license 2 0", "opensource org licenses apache 2 0", "apache 2(?: 0)? licen[cs]e")),
    ("apache-1.1", f"apache (?:software )?{L} {version('1', '1', True)}", "apache 1 1", ("apache org licenses license 1 1",)),
    ("apache-1.0", f"apache (?:software )?{L} {version('1')}", "apache 1 0", ("apache org licenses license 1 0",)),
    ("bsd-2-clause", f"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd) {L}", "bsd 2 clause", ("opensource org licenses bsd 2 clause", "opensource org licenses bsd license(?: php)?")),
    ("bsd-3-clause", f"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd) {L}", "bsd 3 clause", ("opensource org licenses bsd 3 clause", "neither the name of .{1,80} nor the names of its contributors may be used to endorse")),
    ("bsd-4-clause", f"(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd) {L}", "bsd 4 clause", ("all advertising materials mentioning features or use of this software must display",)),
    ("0bsd", f"(?:zero clause bsd|bsd zero clause|0 clause bsd) {L}", "0bsd", ("opensource org licenses 0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted")),
    ("isc", f"(?:isc|internet systems consortium) {L}", "isc", ("opensource org licenses isc(?: license)?", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted")),
    ("gpl-1", f"(?:gnu )?(?:general public {L}|gpl) {version('1')}{LATER}", "gpl 1 0(?: only| or later)?", ("gnu org licenses (?:old licenses )?gpl 1 0",)),
    ("gpl-2", f"(?:gnu )?(?:general public {L}|gpl) {version('2')}{LATER}", "gpl 2 0(?: only| or later)?", ("gnu org licenses (?:old licenses )?gpl 2 0", "gplv2", "either version 2 of the licen[cs]e or at your option any later version")),
    ("gpl-3", f"(?:gnu )?(?:general public {L}|gpl) {version('3')}{LATER}", "gpl 3 0(?: only| or later)?", ("gnu org licenses gpl 3 0", "gplv3", "either version 3 of the licen[cs]e or at your option any later version")),
    ("lgpl-2", f"(?:gnu )?(?:(?:lesser|library) general public {L}|lgpl) {version('2')}{LATER}", "lgpl 2 0(?: only| or later)?", ("gnu org licenses old licenses lgpl 2 0",)),
    ("lgpl-2.1", f"(?:gnu )?(?:(?:lesser|library) general public {L}|lgpl) {version('2', '1', True)}{LATER}", "lgpl 2 1(?: only| or later)?", ("gnu org licenses (?:old licenses )?lgpl 2 1", "lgplv2 1")),
    ("lgpl-3", f"(?:gnu )?(?:lesser general public {L}|lgpl) {version('3')}{LATER}", "lgpl 3 0(?: only| or later)?", ("gnu org licenses lgpl 3 0", "lgplv3")),
    ("agpl-3", f"(?:gnu )?(?:affero general public {L}|agpl) {version('3')}{LATER}", "agpl 3 0(?: only| or later)?", ("gnu org licenses agpl 3 0", "agplv3")),
    ("gfdl-1.2", f"gnu free documentation {L} {version('1', '2', True)}{LATER}", "gfdl 1 2(?: only| or later)?", ("gnu org licenses old licenses fdl 1 2",)),
    ("gfdl-1.3", f"gnu free documentation {L} {version('1', '3', True)}{LATER}", "gfdl 1 3(?: only| or later)?", ("gnu org licenses fdl 1 3",)),
    ("mpl-1.1", f"(?:mozilla public {L}|mpl) {version('1', '1', True)}", "mpl 1 1", ("mozilla org mpl 1 1", "mozilla org mpl mpl 1 1")),
    ("mpl-2", f"(?:mozilla public {L}|mpl) {version('2')}", "mpl 2 0", ("mozilla org mpl 2 0", "subject to the terms of the mozilla public licen[cs]e v 2 0")),
    ("epl-1", f"(?:eclipse public {L}|epl) {version('1')}", "epl 1 0", ("eclipse org legal epl v10", "eclipse org org documents epl v10")),
    ("epl-2", f"(?:eclipse public {L}|epl) {version('2')}", "epl 2 0", ("eclipse org legal epl 2 0", "eclipse org legal epl v20")),
    ("edl-1", f"eclipse distribution {L} {version('1')}", "edl 1 0", ("eclipse org org documents edl v10",)),
    ("cddl-1", f"(?:common development and distribution {L}|cddl) {version('1')}", "cddl 1 0", ("opensource org licenses cddl 1 0", "opensource org licenses cddl1")),
    ("cddl-1.1", f"(?:common development and distribution {L}|cddl) {version('1', '1', True)}", "cddl 1 1", ("glassfish dev java net public cddl gpl 1 1",)),
    ("cpl-1", f"(?:common public {L}|cpl) {version('1')}", "cpl 1 0", ("opensource org licenses cpl1 0",)),
    ("eupl-1.1", f"(?:european union public {L}|eupl) {version('1', '1', True)}", "eupl 1 1", ("joinup ec europa eu software page eupl",)),
    ("eupl-1.2", f"(?:european union public {L}|eupl) {version('1', '2', True)}", "eupl 1 2", ("joinup ec europa eu collection eupl",)),
    ("osl-3", f"(?:open software {L}|osl) {version('3')}", "osl 3 0", ("opensource org licenses osl 3 0",)),
    ("afl-3", f"(?:academic free {L}|afl) {version('3')}", "afl 3 0", ("opensource org licenses afl 3 0",)),
    ("artistic-1", f"artistic {L} {version('1')}", "artistic 1 0(?: perl| cl8)?", ("opensource org licenses artistic license 1 0",)),
    ("artistic-2", f"artistic {L} {version('2')}", "artistic 2 0", ("opensource org licenses artistic license 2 0", "perlfoundation org artistic license 2 0")),
    ("zlib", f"zlib(?: libpng)? {L}", "zlib", ("opensource org licenses zlib", "altered source versions must be plainly marked as such and must not be misrepresented")),
    ("libpng", f"libpng {L}", "libpng(?: 2 0)?", ("libpng org pub png src libpng license",)),
    ("bsl-1", f"boost software {L}(?: {version('1')})?", "bsl 1 0", ("boost org license 1 0", "boost org users license")),
    ("busl-1.1", f"business source {L}(?: {version('1', '1')})?", "busl 1 1", ("mariadb com bsl11",)),
    ("sspl-1", f"server side public {L}(?: {version('1')})?", "sspl 1 0", ("mongodb com licensing server side public license",)),
    ("elastic-2", f"elastic {L} {version('2')}", "elastic 2 0", ("elastic co licensing elastic license",)),
    ("unlicense", "the unlicense", "unlicense", ("unlicense org", "this is free and unencumbered software released into the public domain")),
    ("wtfpl", "(?:wtfpl|do what the f[a-z]* you want to public licen[cs]e)", "wtfpl", ("wtfpl net",)),
    ("cc0-1", "(?:cc0|creative commons zero|cc zero)(?: 1 0)?(?: universal)?", "cc0 1 0", ("creativecommons org publicdomain zero 1 0",)),
    ("pdm-1", "public domain mark(?: 1 0)?", "licenseref pdm 1 0", ("creativecommons org publicdomain mark 1 0",)),
    ("public-domain", "public domain dedication", "licenseref public domain", ("dedicated to the public domain", "(?:placed|released) (?:in|into) the public domain", "this work is in the public domain")),
    ("psf-2", f"(?:python software foundation|psf) {L}(?: {version('2')})?", "psf 2 0", ("python org psf license", "docs python org 3 license html")),
    ("python-2", f"python {L} {version('2')}", "python 2 0", ("opensource org licenses python 2 0",)),
    ("php-3", f"php {L} {version('3')}", "php 3 0", ("php net license 3 0 txt",)),
    ("php-3.01", f"php {L} {version('3', '01', True)}", "php 3 01", ("php net license 3 01",)),
    ("ruby", f"ruby {L}", "ruby", ("ruby lang org en about license",)),
    ("postgresql", f"postgresql {L}", "postgresql", ("opensource org licenses postgresql", "postgresql org about licence")),
    ("ncsa", f"(?:university of illinois ncsa|ncsa) open source {L}", "ncsa", ("opensource org licenses ncsa", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction")),
    ("upl-1", f"universal permissive {L}(?: {version('1')})?", "upl 1 0", ("oss oracle com licenses upl", "opensource org licenses upl")),
    ("vim", f"vim {L}", "vim", ("vimdoc sourceforge net htmldoc uganda",)),
    ("x11", "x window system licen[cs]e", "x11", ("except as contained in this notice the name of the x consortium shall not be used",)),
    ("w3c", f"w3c(?: software(?: notice and)?)? {L}", "w3c(?: 20150513)?", ("w3 org consortium legal copyright software",)),
    ("ofl-1.1", f"(?:sil )?open font {L}(?: {version('1', '1')})?", "ofl 1 1", ("scripts sil org ofl", "openfontlicense org")),
    ("ofl-1.0", f"sil open font {L} {version('1', '0', True)}", "ofl 1 0", ("scripts sil org ofl 1 0",)),
    ("ms-pl", f"(?:microsoft public {L}|ms pl)", "ms pl", ("opensource org licenses ms pl",)),
    ("ms-rl", f"(?:microsoft reciprocal {L}|ms rl)", "ms rl", ("opensource org licenses ms rl",)),
    ("odbl-1", f"(?:open (?:data commons )?(?:open )?database {L}|odbl)(?: {version('1')})?", "odbl 1 0", ("opendatacommons org licenses odbl",)),
    ("odc-by-1", f"(?:open data commons attribution {L}|odc by)(?: {version('1')})?", "odc by 1 0", ("opendatacommons org licenses by",)),
    ("pddl-1", f"(?:public domain dedication and {L}|pddl)", "pddl 1 0", ("opendatacommons org licenses pddl",)),
    ("cdla-permissive-2", f"(?:community data {L} agreement permissive|cdla permissive)(?: {version('2')})?", "cdla permissive 2 0", ("cdla dev permissive 2 0",)),
    ("cdla-sharing-1", f"(?:community data {L} agreement sharing|cdla sharing)(?: {version('1')})?", "cdla sharing 1 0", ("cdla dev sharing 1 0",)),
    ("ogl-uk-3", f"open government {L}(?: {version('3')})?", "ogl uk 3 0", ("nationalarchives gov uk doc open government licence",)),
    ("cecill-2.1", f"cecill(?: free software {L})? {version('2', '1', True)}", "cecill 2 1", ("cecill info licences licence cecill v2 1",)),
    ("cecill-b", f"cecill b(?: {L})?", "cecill b", ("cecill info licences licence cecill b",)),
    ("mulan-2", f"mulan (?:psl|permissive software {L})(?: {version('2')})?", "mulanpsl 2 0", ("license coscl org cn mulanpsl2",)),
    ("openssl", f"openssl {L}", "openssl", ("this product includes software developed by the openssl project",)),
    ("ssleay", f"(?:original )?ssleay {L}", "ssleay", ("this product includes cryptographic software written by eric young",)),
    ("beerware", f"beer ?ware {L}", "beerware", ("you can buy me a beer in return",)),
    ("json", f"json {L}", "json", ("the software shall be used for good not evil",)),
    ("unicode", f"unicode(?: dfs)? {L}(?: agreement)?", "unicode dfs 2016", ("unicode org copyright html", "unicode org license html")),
    ("icu", f"icu {L}", "icu", ("source icu project org repos icu icu trunk license",)),
    ("intel", f"intel open source {L}", "intel", ("opensource org licenses intel open source license",)),
    ("ibm-1", f"ibm public {L}(?: {version('1')})?", "ipl 1 0", ("opensource org licenses ipl 1 0",)),
    ("apsl-2", f"apple public source {L}(?: {version('2')})?", "apsl 2 0", ("opensource apple com license apsl",)),
    ("qpl-1", f"q public {L}(?: {version('1')})?", "qpl 1 0", ("opensource org licenses qpl 1 0",)),
    ("sleepycat", f"sleepycat {L}", "sleepycat", ("opensource org licenses sleepycat",)),
    ("nasa-1.3", f"nasa open source agreement(?: {version('1', '3')})?", "nasa 1 3", ("opensource org licenses nasa1 3",)),
    ("lppl-1.3c", f"latex project public {L}(?: {version('1', '3c')})?", "lppl 1 3c", ("latex project org lppl",)),
    ("llama-2", f"llama 2 community {L}(?: agreement)?", "licenseref llama 2", ("llama 2 is licen[cs]ed under the llama 2 community licen[cs]e",)),
    ("llama-3", f"(?:meta )?llama 3(?: 1| 2| 3)? community {L}(?: agreement)?", "licenseref llama 3", ("built with (?:meta )?llama 3",)),
    ("openrail", f"(?:creative ml |bigscience )?open ?rail(?: m)? {L}", "licenseref openrail", ("bigscience rail licen[cs]e",)),
    ("polyform-nc-1", f"polyform noncommercial {L}(?: {version('1')})?", "polyform noncommercial 1 0 0", ("polyformproject org licenses noncommercial 1 0 0",)),
)

# Creative Commons: suffix of the label, its short form and its long one.
COMMONS = (
    ("by", "by", "attribution"), ("by-sa", "by sa", "attribution share ?alike"), ("by-nd", "by nd", "attribution no ?deriv(?:s|atives|ative works)"), ("by-nc", "by nc", "attribution non ?commercial"),
    ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:s|atives|ative works)"),
)

# A license named without its version, and what only hints at one.
FAMILIES = (
    ("apache", f"apache (?:software )?{L}"), ("bsd", f"bsd(?: style)? {L}"), ("gpl", f"(?:gnu )?general public {L}"), ("gpl", "gnu gpl"), ("lgpl", f"(?:gnu )?(?:lesser|library) general public {L}"), ("agpl", f"(?:gnu )?affero general public {L}"),
    ("gfdl", f"gnu free documentation {L}"), ("mpl", f"mozilla public {L}"), ("epl", f"eclipse public {L}"), ("cddl", f"common development and distribution {L}"), ("eupl", f"european union public {L}"), ("artistic", f"artistic {L}"),
    ("cc", f"creative commons {L}"), ("php", f"php {L}"), ("elastic", f"elastic {L}"), ("cecill", f"cecill(?: free software)? {L}"),
)
HINTS = (
    ("proprietary", "all rights reserved"), ("proprietary", "proprietary and confidential"), ("proprietary", "may not be (?:copied|reproduced|redistributed) without (?:the )?(?:prior )?(?:express )?written permission"),
    ("proprietary", f"commercial {L} agreement"), ("proprietary", f"end user {L} agreement"), ("unspecified", f"see (?:the )?{L} file"), ("unspecified", f"{L} information"),
    ("unspecified", "redistribution and use in source and binary forms"), ("unspecified", "this software is provided (?:by the .{1,80} )?as is"), ("copyleft", "copyleft"),
)


def plain_word(template: str) -> str:
    """The longest word that stands outside of all groups, '' if none does."""
    bare, was = re.sub(r"\\.|\[[^]]*\]\??|\.\{[^}]*\}", "*", template), None
    while was != bare:
        was, bare = bare, re.sub(r" ?\(\?:[^()]*\)\??", " * ", bare)
    bare = re.sub(r".\?", "*", bare)
    return max((w for w in bare.split() if re.fullmatch("[a-z0-9]+", w)), key=len, default="")


def keyword(template: str) -> str:
    """Words of which every match of a template has one, parted by |; '' if
    there are none. Where all words are in groups, each choice of an outer group
    has a word of its own."""
    word = plain_word(template)
    if word:
        return word
    depth, start, cuts = 0, 0, []
    for k, c in enumerate(template):
        if c == "(":
            depth += 1
            if depth == 1:
                start, cuts = k + 3, []
        elif c == "|" and depth == 1:
            cuts.append(k)
        elif c == ")":
            depth -= 1
            if depth == 0 and template[k + 1 : k + 2] != "?":
                ends = [start, *[x + 1 for x in cuts]], [*cuts, k]
                words = [plain_word(template[x:y]) for x, y in zip(*ends, strict=True)]
                if all(words):
                    return "|".join(dict.fromkeys(words))
    return ""


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, template) in order."""
    out = [(label, NOTICE, keyword(phrase), phrase) for phrase, label in BASE]
    tag = f"spdx {L} identifier "
    for label, name, spdx, own in LICENSES:
        out += [(label, TAG, keyword(spdx) or "spdx", tag + spdx), (label, NOTICE, keyword(name) or "under", GRANT + name), (label, TITLE, keyword(name), name)]
        out += [(label, NOTICE, keyword(x), x) for x in own]
    for suffix, short, long in COMMONS:
        label, place = f"cc-{suffix}", short.replace(" ", " ")
        edition = "(?: (?:version |v )?[1-4] [05])?(?: international| unported| generic)?"
        names = (f"cc {short}{edition}", f"creative commons {short}{edition}(?: {L})?", f"creative commons {long}(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: {L})?")
        out += [(label, TAG, "spdx", f"{tag}cc {short} [1-4] [05]"), (label, NOTICE, "creativecommons", f"creativecommons org licenses {place} [1-4] [05]")]
        out += [x for n in names for x in ((label, NOTICE, "under", GRANT + "(?:an? )?" + n), (label, TITLE, keyword(n), n))]
    out += [x for label, name in FAMILIES for x in ((label, FAMILY, keyword(name), GRANT + name), (label, FAMILY, keyword(name), name))]
    return out + [(label, HINT, keyword(x), x) for label, x in HINTS]


RULES = rules()
#: Of these every text with a match has one, in lower case: plain words, looked
#: for one after the other, and pairs whose first word alone is no hint.
GATE_WORDS = (
    "licen", "copyleft", "spdx", "gpl", "cddl", "eupl", "wtfpl", "cecill", "odbl", "pddl", "mulan", "mozilla", "eclipse", "creative", "cc0", "permission is hereby", "permission to use", "rights reserved", "confidential",
    "redistribution and", "to endorse", "advertising materials", "plainly marked", "opensource", "openssl", "eric young", "not evil", "unicode", "cdla", "is provided", "unencumbered", "written permission",
    "option any later", "joinup", "glassfish", "mariadb", "vimdoc", "x consortium",
)
GATE_PAIRS = "(?:c(?:c|pl)|m(?:s|pl)|o(?:dc|sl)|epl|a(?:pl|sl|fl)|gnu|sil|project|w3|public|domain|built|nasa|beer)" + BETWEEN + "(?:by|zero|pl|rl|v|[0-9]|org|domain|with|open|in)"


def gate(low: Column) -> Column:
    """A cheap look at a text in lower case. Words of a pair, and those of a
    plain hint, may be parted by whatever stands between words."""
    found = low.contains(GATE_WORDS[0])
    for word in GATE_WORDS[1:]:
        found = found | (low.contains(word) if " " not in word else low.contains(max(word.split(), key=len)))
    return found | low.rlike(GATE_PAIRS)


def pattern(template: str) -> str:
    """A template over the form ` word  word `."""
    return " " + template.replace(" ?", "\x00").replace(" ", "  ").replace("\x00", "(?:  )?") + " "


def word_form(text: Column) -> Column:
    low = F.translate(text, UPPER, LOWER)
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(low, BETWEEN, "  ")), F.lit(" "))


def words_in(form: Column) -> Column:
    """How many words a piece of the form has."""
    return ((F.length(form) - F.length(F.replace(form, F.lit(" "), F.lit("")))) / 2).cast("int")


def base_places(form: Column, n_words: Column, phrase: str) -> Column:
    """struct<n, first, last> of a phrase: its places and the first and last."""
    found, size = pattern(phrase), len(phrase.split())
    n = ((F.length(form) - F.length(F.replace(form, F.lit(found), F.lit("")))) / len(found)).cast("long")
    first = words_in(F.substring_index(form, found, 1)).cast("long")
    last = n_words - words_in(F.substring_index(form, found, -1)) - size
    return F.struct(n.alias("n"), F.when(n > 0, first).alias("first"), F.when(n > 0, last).alias("last"))


def rule_matches(form: Column) -> Column:
    """array<struct<rule, i, before, size>>: of every rule its matches, their
    number, the words since the match before, and their words."""
    listed = F.array(*[F.struct(F.lit(k).alias("rule"), F.array(*[F.lit(f" {w} " if w else " ") for w in need.split("|")]).alias("needs"), F.lit(pattern(t)).alias("pattern")) for k, (_, _, need, t) in enumerate(RULES)])
    wanted = F.filter(listed, lambda r: F.exists(r["needs"], lambda w: form.contains(w)))

    def of_rule(r: Column) -> Column:
        size = F.transform(F.regexp_extract_all(form, r["pattern"], F.lit(0)), words_in)
        gaps = F.transform(F.split(form, r["pattern"], -1), words_in)
        # One gap more than matches; the last zipped row has no match.
        pairs = F.filter(F.arrays_zip(size.alias("size"), gaps.alias("gap")), lambda x: x["size"].isNotNull())
        return F.transform(pairs, lambda x, i: F.struct(r["rule"].alias("rule"), i.alias("i"), x["gap"].alias("before"), x["size"].alias("size")))

    return F.flatten(F.transform(wanted, of_rule))


def scan(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, row_key (null where nothing matches), n_words, base and found."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n_words = F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"), n_words.alias("n_words"))
    # Inside lambdas, so that the form and the text in lower case are made once.
    looked = F.transform(F.array(word_form(F.col("text"))), lambda form: F.struct(F.array(*[base_places(form, F.col("n_words"), p) for p, _ in BASE]).alias("base"), rule_matches(form).alias("found")))[0]
    # Letters beyond A-Z that fold into them only let more texts pass.
    passes = F.transform(F.array(F.lower("text")), gate)[0]
    rows = rows.withColumn("seen", F.when(passes, looked))
    key = F.when(F.size("seen.found") > 0, row_key(F.col("id"), F.col("text")))
    return rows.select("id", key.alias("row_key"), "n_words", F.col("seen.base").alias("base"), F.col("seen.found").alias("found"))


def surviving(found: DataFrame) -> DataFrame:
    """(row_key, rule, label, priority, start, end) of the detections that no
    other one suppresses. found: row_key, rule, i, before, size."""
    here = Window.partitionBy("row_key", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    labels, priorities = (F.array(*[F.lit(r[k]) for r in RULES]) for k in (0, 1))
    of = lambda values: F.element_at(values, F.col("rule") + 1)
    placed = found.withColumn("end", F.sum(F.col("before") + F.col("size")).over(here).cast("int")).select(
        "row_key", "rule", of(labels).alias("label"), of(priorities).alias("priority"), (F.col("end") - F.col("size")).alias("start"), "end"
    )
    order = Window.partitionBy("row_key").orderBy("start", F.col("end").desc(), F.col("priority").desc(), "rule").rowsBetween(Window.unboundedPreceding, -1)
    # Whatever spans a detection comes before it in this order.
    for p in WEIGHTS:
        placed = placed.withColumn(f"_reach{p}", F.max(F.when(F.col("priority") >= p, F.col("end"))).over(order))
    reach = F.element_at(F.array(*[F.col(f"_reach{p}") for p in sorted(WEIGHTS)]), F.col("priority") + 1)
    return placed.where(reach.isNull() | (reach < F.col("end"))).drop(*[f"_reach{p}" for p in WEIGHTS])


def find_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of df: id_col, n_words, n_base, first_word, last_word,
    base_labels, detections (array<struct<start, end, label, priority>>, in
    order; spans of words) and score."""
    scanned = materialize(scan(df, id_col, text_col), "license-scan")
    found = scanned.where("row_key is not null").select("row_key", F.explode("found").alias("m")).select("row_key", "m.*").distinct()
    each = surviving(found).groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "label", "priority"))).alias("detections"))
    none = F.array().cast(each.schema["detections"].dataType)
    # Rows without a match do not move.
    rows = scanned.where("row_key is null").withColumn("detections", none).unionByName(scanned.where("row_key is not null").join(each, "row_key"))
    base, of = F.coalesce("base", F.array().cast(scanned.schema["base"].dataType)), lambda name: F.transform(F.col("base"), lambda b: b[name])
    rows = rows.withColumn("base", base)
    held = F.filter(F.transform("base", lambda b, i: F.when(b["n"] > 0, F.element_at(F.array(*[F.lit(x) for _, x in BASE]), i + 1))), lambda x: x.isNotNull())
    weight = F.transform("detections", lambda d: F.element_at(F.array(*[F.lit(WEIGHTS[p]) for p in sorted(WEIGHTS)]), d["priority"] + 1))
    return rows.select(
        F.col("id").alias(id_col), "n_words", F.aggregate(of("n"), F.lit(0).cast("long"), lambda a, x: a + x).alias("n_base"), F.array_min(of("first")).alias("first_word"), F.array_max(of("last")).alias("last_word"),
        F.array_sort(F.array_distinct(held)).alias("base_labels"), "detections", F.coalesce(F.array_max(weight), F.lit(0.0)).alias("score"),
    )


def op12_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(table(spark, sf_dir, "documents"))
    labels = F.array_sort(F.array_union("base_labels", F.transform("detections", lambda d: d["label"])))
    spans = F.array_join(F.transform("detections", lambda d: F.concat_ws(":", d["label"], d["start"], d["end"])), ",")
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), "score", spans.alias("spans"))


def _op12_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ",\n  ".join(f"({k}, {quoted(label)}, {p}, [{', '.join(quoted(f' {w} ' if w else ' ') for w in need.split('|'))}], {quoted(pattern(t))})" for k, (label, p, need, t) in enumerate(RULES))
    phrases = ", ".join(f"({k}, {quoted(pattern(p))}, {quoted(label)}, {len(p.split())})" for k, (p, label) in enumerate(BASE))
    weights = " ".join(f"WHEN {p} THEN {w}::DOUBLE" for p, w in WEIGHTS.items())
    words = lambda x: f"CAST((length({x}) - length(replace({x}, ' ', ''))) / 2 AS BIGINT)"
    return rf"""WITH low AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
d AS (SELECT rid, doc_id, len(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS n_words, ' ' || trim(regexp_replace(t, '{BETWEEN}', '  ', 'g'), ' ') || ' ' AS form FROM low),
rule(rule, label, priority, needs, pattern) AS (VALUES
  {values}),
ph(k, phrase, label, size) AS (VALUES {phrases}),
b AS (SELECT rid, label, string_split(form, phrase) AS pieces, size, n_words FROM d, ph WHERE contains(form, phrase)),
bn AS (SELECT rid, sum(len(pieces) - 1) AS n, min({words("pieces[1]")}) AS first_word, max(n_words - {words("pieces[len(pieces)]")} - size) AS last_word, list(DISTINCT label) AS labels FROM b GROUP BY rid),
m AS (SELECT rid, rule, label, priority, regexp_extract_all(form, pattern) AS whole, string_split_regex(form, pattern) AS gaps FROM d, rule WHERE len(list_filter(needs, lambda w: contains(form, w))) > 0 AND regexp_matches(form, pattern)),
u AS (SELECT rid, rule, label, priority, unnest(whole) AS w, unnest(gaps[1:len(whole)]) AS g, unnest(generate_series(1, len(whole))) AS i FROM m),
e AS (SELECT rid, rule, label, priority, CAST(sum({words("g")} + {words("w")}) OVER (PARTITION BY rid, rule ORDER BY i) AS BIGINT) AS e, {words("w")} AS n FROM u),
s AS (SELECT rid, rule, label, priority, e - n AS s, e FROM e),
k AS (
  SELECT * FROM s a WHERE NOT EXISTS (
    SELECT 1 FROM s b WHERE b.rid = a.rid AND b.s <= a.s AND b.e >= a.e AND b.priority >= a.priority AND (b.s < a.s OR b.e > a.e OR b.priority > a.priority OR b.rule < a.rule))),
g AS (SELECT rid, list(DISTINCT label) AS labels, string_agg(label || ':' || s || ':' || e, ',' ORDER BY s, e, label, priority) AS spans, max(CASE priority {weights} END) AS score FROM k GROUP BY rid)
SELECT d.doc_id, d.n_words, CAST(coalesce(bn.n, 0) AS BIGINT) AS n_base, CAST(bn.first_word AS BIGINT) AS first_word, CAST(bn.last_word AS BIGINT) AS last_word,
  array_to_string(list_sort(coalesce(bn.labels, [])), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(bn.labels, []), coalesce(g.labels, [])))), ',') AS labels,
  coalesce(g.score, 0::DOUBLE) AS score, coalesce(g.spans, '') AS spans
FROM d LEFT JOIN bn USING (rid) LEFT JOIN g USING (rid)"""


OP12_SQL = _op12_sql()
