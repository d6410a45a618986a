"""Personal data replaced by keyed surrogates of the same type and format.

Entities are found by one pattern of all ``KINDS``.  The distinct entities of the
corpus become a dictionary: a surrogate follows from a key, the kind, the
canonical form and an attempt, by SHA-256.  Surrogates that two entities share,
or that are themselves entities of the corpus, go to the next attempt, for names and
mail addresses with more syllables or digits.  Where a format has too few values,
as 192.168.*.* has, those left after ``MAX_ATTEMPTS`` get another entity of that
format, the next in an order that the key gives.  So different entities stay
different and one entity gets one surrogate in all documents.

Numbers keep their punctuation and length, cards that pass the check digit go on
passing it, phone numbers keep their country code, addresses stay valid and
private ones private, secrets keep their shape, mail addresses keep the shape of
the part before the @ and get a reserved domain, IBANs keep their country and
pass their check digits.  Names after a form of address keep that form, its
gender and their script and number of words; with and without a point the form is
the same.  Their words alone, "Anna Smith" or "Smith", are replaced wherever else
the document has them, and not counted.

Only SQL functions are used.  Null texts stay null, texts without entities are
not moved.  Repeated rows get equal texts; ids may be null or repeat, as rows are
recognised by id and a hash of their text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logveil.functions.rules import BUILTIN_RULES
from logveil.llm.common import NO_ID, unused
from logveil.sources.staging import staged

#: Draws after which the entities left get entities of their own format: the kind has too few other values.
MAX_ATTEMPTS = 64
#: Entities among which a successor is looked for in one task.
RING = 10_000

FORMS = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme M. Señor Señora Sr Sra Don Doña Г-н Г-жа Господин Госпожа Κος Κα".split()
_FORM = "(?:" + "|".join("M(?=[.])" if form == "M." else form for form in FORMS) + ")"


def _credentials() -> str:
    """The values of the catalogue's rules for credentials, each behind its prefix, which a look-behind must bound."""
    out = []
    for rule in (r for r in BUILTIN_RULES if r.category in ("auth_header", "password", "api_key")):
        for alternative in re.split(r"\|(?=\(\")", rule.pattern):
            depth = end = 0
            for end, c in enumerate(alternative):
                depth += (c == "(") - (c == ")")
                if not depth:
                    break
            prefix, value = alternative[1:end].replace(r"\s*", r"\s{0,8}").replace(r"\s+", r"\s{1,8}"), alternative[end + 1:]
            if '"' not in prefix:
                out.append(rf'(?<=(?i:{prefix})")[^"\n]{{1,512}}(?=")')
                prefix += "'?"
            out.append(f"(?<=(?i:{prefix})){value}")
    # what ends every prefix comes first, so that few places try the long look-behinds
    return rf"""(?<=[=:"'\s])(?<=[=:]\s{{0,8}}["']?|(?i:basic|bearer|digest)\s{{1,8}}["']?)(?:{"|".join(out)})"""


_LONG = r"(?<![0-9A-Za-z+/=_-])(?=[A-Za-z+_-]*[0-9])(?=[0-9a-z+_-]*[A-Z])(?=[0-9A-Z+_-]*[a-z])[0-9A-Za-z+_-]{32,512}={0,2}(?![0-9A-Za-z/])"
#: Kinds in order of precedence, as patterns of the regular expressions of Java; ``ip`` has IPv6 as well, ``card`` IBANs.
KINDS = {
    "secret": r"(?<![0-9A-Za-z])(?=[0-9]*[a-fA-F])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{32,128}(?![0-9A-Za-z])"
              r"|(?<![0-9A-Za-z_-])eyJ[0-9A-Za-z_-]{5,}\.[0-9A-Za-z_-]{5,}(?:\.[0-9A-Za-z_-]+)?"
              r"|(?<![0-9A-Za-z])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])"
              r"|(?<![0-9A-Za-z])(?:sk-[0-9A-Za-z_-]{16,}|gh[opsur]_[0-9A-Za-z]{20,})"
              rf"|{_LONG}|(?<![0-9A-Za-z+/])[0-9A-Za-z+/]{{30,512}}={{1,2}}(?![0-9A-Za-z=])",
    "email": r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]{1,64}+@[\p{L}\p{M}\p{N}-]{1,63}(?:\.[\p{L}\p{M}\p{N}-]{1,63}){1,8}(?![\p{L}\p{M}\p{N}-])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])"
          r"|(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*[0-9A-Fa-f]{2})(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?"
          r"::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![0-9A-Za-z:])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -]){3}[0-9]{1,7}(?![0-9A-Za-z])|(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])"
            r"|(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?|[0-9A-Z]{11,30})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9-])"
             r"|(?<![0-9A-Za-z+])\+[1-9][0-9]{6,14}(?![0-9])|(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}(?:[ .-][0-9]{1,5}){2,6}(?![0-9-])"
             r"|(?<![0-9A-Za-z+.-])0[1-9](?:[ .][0-9]{2}){4}(?![0-9-])",
    "name": rf"(?<!\p{{L}}){_FORM}\.?[ ]\p{{Lu}}\p{{L}}{{1,30}}+(?:[ -]\p{{Lu}}\p{{L}}{{1,30}}+){{0,2}}",
}
# Forms of address by gender, given names and syllables by script.
FEMALE = "Mrs Ms Miss Frau Madame Mme Señora Sra Doña Г-жа Госпожа Κα".split()
MALE = "Mr Herr Monsieur M Señor Sr Don Г-н Господин Κος".split()
NAMES = {
    "latin": {"f": "Ada Berta Clara Dora Elsa Flora Greta Hanna Ida Julia Karla Lena Maria Nora Olga Paula".split(),
              "m": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Nils Oskar Paul".split(),
              "s": "ba de fi go lu ma ne pi ro sa te vo wi ka le mo".split()},
    "cyrillic": {"f": "Анна Вера Галина Дарья Елена Жанна Зоя Инна Кира Лидия Мария Нина Ольга Полина Раиса Софья".split(),
                 "m": "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Степан".split(),
                 "s": "ба де фи го лу ма не пи ро са те во ви ка ле мо".split()},
    "greek": {"f": "Αννα Βασω Γιωτα Δωρα Ελενη Ζωη Ηρω Θεα Ιριδα Καλη Λιζα Μαρια Νικη Ξενια Ολγα Ρεα".split(),
              "m": "Αρης Βασος Γιωργος Δημος Ευαγγελος Ζησης Ηλιας Θανος Ιων Κωστας Λεων Μανος Νικος Ορεστης Πετρος Σακης".split(),
              "s": "βα δε φι γο λου μα νε πι ρο σα τε βο κι κα λε μο".split()},
}

ANY = "|".join(f"(?:{p})" for p in [_credentials(), *KINDS.values()])
#: What a text without digit and @ has that holds a secret or an address: a prefix, a run of base64 with its padding, groups between colons.
_PREFIXES = "eyJ AKIA ASIA sk- gho_ ghp_ ghs_ ghu_ ghr_ ::".split()
_PADDED, _GROUPS = "[0-9A-Za-z+/]{30}", "[0-9a-fA-F]:[0-9a-fA-F]{1,4}:"
#: What it has that names a credential, in lower case.
_NAMED = "authorization passw pwd secret token bearer apikey api_key api-key".split()
#: A name behind a form of address, found by the space between them.
_ADDRESSED = rf" (?=\p{{Lu}})(?<={_FORM}\.? )"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def found_expr(text: str) -> str:
    return f"regexp_extract_all({text}, {_quoted(ANY)}, 0)"


def gate_expr(text: str) -> str:
    """Cheap and implied by every kind: a digit, an @, a form of address or what tells a credential.

    A credential is named before a colon or an equals sign, so few texts are searched for its names.
    """
    holds = lambda what, values: "(" + " OR ".join(f"contains({what}, '{v}')" for v in values) + ")"
    return (f"{text} rlike '[0-9@]' OR {text} rlike {_quoted(_ADDRESSED)} OR {holds(text, _PREFIXES)} "
            f"OR (contains({text}, ':') OR contains({text}, '=')) AND ({holds(f'lower({text})', _NAMED)} "
            f"OR {text} rlike {_quoted(_PADDED)} OR {text} rlike {_quoted(_GROUPS)})")


def kind_expr(value: str) -> str:
    """The kind of an entity; look-arounds hold at the ends of a string of its own, save those of credentials."""
    return "CASE " + " ".join(f"WHEN {value} rlike {_quoted(f'^(?:{p})$')} THEN '{k}'" for k, p in KINDS.items()) + " ELSE 'secret' END"


def canonical_expr(kind: str, value: str) -> str:
    return (f"CASE WHEN {kind} IN ('phone', 'card', 'ssn') THEN regexp_replace({value}, '[^0-9A-Z]', '') "
            f"WHEN {kind} = 'email' THEN lower({value}) WHEN {kind} = 'name' THEN regexp_replace({value}, '^([^ .]+)[.] ', '$1 ') ELSE {value} END")


def _byte(i: str) -> str:
    """A number from 0 to 65535 of the stream ``d``, of which there are 16 for each block of 64 hexadecimal digits."""
    return f"cast(conv(substr(d, 1 + 4 * ({i}), 4), 16, 10) AS int)"


def _pick(values: str, i: str) -> str:
    return f"{values}[pmod({_byte(i)}, size({values}))]"


def _shaped(value: str, first: str = "0") -> str:
    """``value`` with letters and digits replaced by others of their class, from place ``first`` on."""
    digits, lower, upper = "'0123456789'", "'abcdefghijklmnopqrstuvwxyz'", "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
    at = lambda chars, n: f"substr({chars}, 1 + pmod({_byte('i')}, {n}), 1)"
    return (f"array_join(transform(split({value}, ''), (c, i) -> CASE WHEN i < {first} THEN c WHEN c rlike '[0-9]' THEN {at(digits, 10)} "
            f"WHEN c rlike '[A-Z]' THEN {at(upper, 26)} WHEN c rlike '[\\\\p{{L}}\\\\p{{M}}\\\\p{{N}}]' THEN {at(lower, 26)} ELSE c END), '')")


def _luhn(number: str) -> str:
    """The sum of a number's digits, every second one from the right doubled."""
    return (f"aggregate(transform(split(reverse({number}), ''), (c, i) -> if(i % 2 = 0, cast(c AS int), "
            "if(cast(c AS int) > 4, 2 * cast(c AS int) - 9, 2 * cast(c AS int)))), 0, (a, x) -> a + x)")


def _card() -> str:
    body = "substr(s, 1, char_length(s) - 1)"
    checked = f"concat({body}, cast(pmod(10 - pmod({_luhn(f'concat({body}, 0)')}, 10), 10) AS string))"
    rest = lambda x: (f"aggregate(split({x}, ''), 0, (a, c) -> pmod(if(c rlike '[0-9]', a * 10 + cast(c AS int), a * 100 + ascii(c) - 55), 97))")
    country, account = "substr(v, 1, 2)", "substr(s, 5)"
    iban = f"concat({country}, lpad(cast(98 - {rest(f'concat({account}, {country}, 0, 0)')} AS string), 2, '0'), {account})"
    return (f"CASE WHEN v rlike '^[A-Z]' THEN {_let('s', _shaped('v'), iban)} "
            f"WHEN pmod({_luhn('v')}, 10) = 0 THEN {_let('s', _shaped('v'), checked)} ELSE {_shaped('v')} END")


def _ip() -> str:
    octet = f"cast(1 + pmod({_byte('i')}, 254) AS string)"
    kept = "CASE WHEN v rlike '^(?:10|127)[.]' THEN 1 WHEN v rlike '^192[.]168[.]' THEN 2 ELSE 0 END"
    four = f"array_join(transform(split(v, '[.]'), (c, i) -> if(i < {kept}, c, {octet})), '.')"
    # the first group of a local or private IPv6 address stays
    six = (f"array_join(transform(sequence(0, 7), i -> if(i = 0, if(v rlike '(?i)^(?:fe[89ab]|f[cd])', split(v, ':')[0], '2001'), "
           f"lower(hex({_byte('i')})))), ':')")
    return f"if(contains(v, ':'), {six}, {four})"


def _secret() -> str:
    hexed = "substr(d, 1, char_length(v))"
    known = "CASE WHEN v rlike '^(?:eyJ|sk-)' THEN 3 WHEN v rlike '^(?:AKIA|ASIA|gh[opsur]_)' THEN 4 ELSE 0 END"
    return (f"CASE WHEN v rlike '^[0-9a-f]{{32,128}}$' THEN {hexed} WHEN v rlike '^[0-9A-F]{{32,128}}$' THEN upper({hexed}) "
            f"WHEN char_length(v) < 8 THEN concat({_shaped('v')}, substr(d, 33, 8)) ELSE {_shaped('v', known)} END")


def _name(attempt: str) -> str:
    """Form of address, a given name if there are two words or more, and a family name of syllables."""
    def family(script: str, i: str) -> str:
        syllables = _list(NAMES[script]["s"])
        more = "".join(f", {_pick(syllables, str(16 + k))}" for k in range(int(attempt) // 2))
        return f"initcap(concat({_pick(syllables, i)}, {_pick(syllables, f'{i} + 1')}, {_pick(syllables, f'{i} + 2')}, {_pick(syllables, f'{i} + 3')}{more}))"

    def words(script: str) -> str:
        female, male = _list(NAMES[script]["f"]), _list(NAMES[script]["m"])
        given = (f"CASE WHEN array_contains({_list(FEMALE)}, p) THEN {_pick(female, '8 + i')} WHEN array_contains({_list(MALE)}, p) "
                 f"THEN {_pick(male, '8 + i')} ELSE {_pick(f'concat({female}, {male})', '8 + i')} END")
        return f"transform(slice(w, 2, size(w)), (x, i) -> if(i < size(w) - 2, {given}, {family(script, '0')}))"

    by_script = (f"CASE WHEN v rlike '[\\\\p{{IsCyrillic}}]' THEN {words('cyrillic')} WHEN v rlike '[\\\\p{{IsGreek}}]' THEN {words('greek')} "
                 f"ELSE {words('latin')} END")
    return _let("w", "split(regexp_replace(v, '(?<=[ ][^ ]{1,99})-', ' '), ' ')",
                _let("p", "replace(w[0], '.', '')", f"concat(w[0], ' ', array_join({by_script}, ' '))"))


def surrogate_expr(key: str, kind: str, value: str, attempt: str) -> str:
    """The surrogate of a canonical form."""
    seed = f"concat_ws('|', '{key}', {kind}, v, cast({attempt} AS string))"
    stream = (f"array_join(transform(sequence(0, char_length(v) div 16 + {1 + int(attempt) // 16}), b -> sha2(concat('{key}', sha2(concat_ws('|', {seed}, cast(b AS string)), 256)), 256)), '')")
    local = "substring_index(v, '@', 1)"
    more = "".join(f", lpad(cast(pmod({_byte(f'char_length(v) + {k + 1}')}, 1000) AS string), 3, '0')" for k in range(int(attempt) // 4))
    email = f"concat({_shaped(local)}, '@mail', cast(pmod({_byte('char_length(v)')}, 1000) AS string){more}, '.example.com')"
    phone = f"if(char_length(v) > 10, {_shaped('v', 'char_length(v) - 10')}, {_shaped('v')})"
    by_kind = (f"CASE {kind} WHEN 'secret' THEN {_secret()} WHEN 'email' THEN {email} WHEN 'ip' THEN {_ip()} WHEN 'card' THEN {_card()} "
               f"WHEN 'phone' THEN {phone} WHEN 'ssn' THEN {_shaped('v')} ELSE {_name(attempt)} END")
    return _let("v", value, _let("d", stream, by_kind))


def written_expr(kind: str, value: str, surrogate: str) -> str:
    """A surrogate in the format in which the entity is written: digits are put in one by one, a form of address keeps its point."""
    digits = (f"aggregate(split({value}, ''), named_struct('t', '', 'n', 1), (a, c) -> if(c rlike '[0-9A-Z]', "
              f"named_struct('t', concat(a.t, substr({surrogate}, a.n, 1)), 'n', a.n + 1), named_struct('t', concat(a.t, c), 'n', a.n)), a -> a.t)")
    return (f"CASE WHEN {kind} IN ('phone', 'card', 'ssn') THEN {digits} WHEN {kind} = 'name' AND {value} rlike '^[^ .]+[.] ' "
            f"THEN regexp_replace({surrogate}, '^([^ ]+) ', '$1. ') ELSE {surrogate} END")


def bare_expr(entries: str) -> str:
    """From words of the names among the ``(value, kind, text)`` of a document, without form of address, to their surrogates.

    Of names that share a word the first in order gives its surrogate.
    """
    words = lambda x: f"regexp_replace(regexp_replace({x}, '^[^ ]+ ', ''), '-', ' ')"
    whole = f"transform(n, e -> struct(regexp_replace(e.value, '^[^ ]+ ', '') AS k, {words('e.text')} AS t))"
    each = f"flatten(transform(n, e -> zip_with(split({words('e.value')}, ' '), split({words('e.text')}, ' '), (x, y) -> struct(x AS k, y AS t))))"
    both = f"concat({whole}, {each})"
    names = f"array_sort(filter({entries}, e -> e.kind = 'name'))"
    return _let("n", names, _let("b", both, "map_from_entries(filter(transform(array_distinct(b.k), w -> "
                                            "struct(w AS k, filter(b, x -> x.k = w)[0].t AS t)), x -> x.t IS NOT NULL))"))


def rest_expr(text: str) -> str:
    """A text between entities with the bare names of ``b`` replaced; ``r`` is their pattern, null without any."""
    return (f"if(r IS NULL, {text}, transform(array(struct(split({text}, r, -1) AS p, regexp_extract_all({text}, r, 0) AS f)), "
            "s -> concat(s.p[0], array_join(transform(s.f, (x, i) -> concat(b[x], s.p[i + 1])), '')))[0])")


def dictionary(entities: DataFrame, key: str) -> DataFrame:
    """``(kind, canonical, surrogate)`` of distinct ``(kind, canonical)``: distinct surrogates, none of them an entity."""
    pending, settled = entities.withColumn("attempt", F.lit(0)), None
    for attempt in range(MAX_ATTEMPTS):
        drawn = staged(pending.select("kind", "canonical", F.expr(surrogate_expr(key, "kind", "canonical", str(attempt))).alias("surrogate")), "drawn")
        first = drawn.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical"))
        taken = entities.select("kind", F.col("canonical").alias("surrogate"))
        if settled is not None:
            taken = taken.unionAll(settled.select("kind", "surrogate"))
        good = staged(first.join(taken, ["kind", "surrogate"], "left_anti").select("kind", "canonical", "surrogate"), "surrogates")
        settled = good if settled is None else settled.unionAll(good)
        pending = staged(drawn.join(good, ["kind", "canonical"], "left_anti").select("kind", "canonical"), "collisions")
        if pending.isEmpty():
            return settled
    return settled.unionAll(successors(entities, pending, key))


def format_expr(kind: str, value: str) -> str:
    """The format that a surrogate shares with its entity, for kinds with few values."""
    return (f"CASE WHEN {kind} = 'ip' THEN regexp_extract({value}, '^(?:10[.]|127[.]|192[.]168[.]|[^.]*:)?', 0) "
            f"WHEN {kind} = 'phone' THEN concat(char_length({value}), ' ', substr({value}, 1, greatest(0, char_length({value}) - 10))) "
            f"WHEN {kind} = 'card' AND {value} rlike '^[0-9]' THEN concat(char_length({value}), ' ', pmod({_luhn(value)}, 10) = 0) "
            f"ELSE regexp_replace(regexp_replace({value}, '[0-9]', '0'), '[a-z]', 'a') END")


def successors(entities: DataFrame, pending: DataFrame, key: str) -> DataFrame:
    """``(kind, canonical, surrogate)`` of the ``pending`` among the ``entities``: the next entity of the format, around rings of
    about ``RING`` in the order of a keyed hash.  No draw is an entity, so these are distinct from all drawn surrogates."""
    left = staged(pending.select("kind", F.expr(format_expr("kind", "canonical")).alias("format"), "canonical"), "left")
    every = entities.select("kind", F.expr(format_expr("kind", "canonical")).alias("format"), "canonical") \
        .withColumn("at", F.expr(f"sha2(concat('{key}', sha2(concat_ws('|', '{key}', kind, canonical), 256)), 256)"))
    sizes = every.groupBy("kind", "format").agg(F.count("*").alias("size")).join(left.select("kind", "format").distinct(), ["kind", "format"])
    rings = every.join(F.broadcast(sizes), ["kind", "format"]) \
        .withColumn("ring", F.expr(f"pmod(xxhash64(at), greatest(1L, size div {RING}))"))
    ring = Window.partitionBy("kind", "format", "ring")
    after = F.coalesce(F.lead("canonical").over(ring.orderBy("at", "canonical")), F.first("canonical").over(
        ring.orderBy("at", "canonical").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    found = staged(rings.select("kind", "canonical", after.alias("surrogate")).join(left.select("kind", "canonical"), ["kind", "canonical"]), "successors")
    if not found.where("canonical = surrogate").isEmpty():
        raise ValueError("a format with a single value has no surrogate")
    return found.select("kind", "canonical", "surrogate")


def pseudonymise(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``entities``: a map from kind to the number found."""
    if not key.isalnum():
        raise ValueError("a key of letters and digits is needed")
    found, row, own, known, done = (unused(docs, n) for n in ("_found", "_row", "_id", "_known", "_done"))
    columns = [c for c in docs.columns if c != "entities"]
    rows = docs.select(*columns)
    gate = F.coalesce(F.expr(gate_expr(f"`{text}`")), F.lit(False))
    # a generator of one row keeps the optimizer from copying the search into every use of it
    some = staged(rows.where(gate).withColumn(own, F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID))).withColumn(row, F.xxhash64(text))
                  .select("*", F.explode(F.array(F.expr(found_expr(f"`{text}`")))).alias(found)), "searched")
    values = some.select(own, row, F.explode(F.array_distinct(found)).alias("value"))
    values = values.withColumn("kind", F.expr(kind_expr("value"))).withColumn("canonical", F.expr(canonical_expr("kind", "value")))
    values = staged(values, "entities")
    entries = dictionary(values.select("kind", "canonical").distinct(), key)
    written = values.join(entries, ["kind", "canonical"]).select(
        own, row, F.struct("value", "kind", F.expr(written_expr("kind", "value", "surrogate")).alias("text")).alias("e"))
    maps = written.groupBy(own, row).agg(F.collect_set("e").alias(known))
    pattern = ("if(size(b) = 0, cast(null AS string), concat('(?<!\\\\p{L})(?:', array_join(transform(array_sort(transform(map_keys(b), "
               "w -> struct(-char_length(w) AS n, w AS w))), x -> x.w), '|'), ')(?!\\\\p{L})'))")
    whole = f"concat({rest_expr('p[0]')}, array_join(transform({found}, (x, i) -> concat(k[x].text, {rest_expr('p[i + 1]')})), ''))"
    put = (f"if({known} IS NULL, struct(`{text}` AS text, cast(array() AS array<string>) AS kinds), "
           f"transform(array(map_from_entries(transform({known}, e -> struct(e.value, e)))), k -> "
           f"transform(array(split(`{text}`, {_quoted(ANY)}, -1)), p -> struct("
           f"{_let('b', bare_expr(known), _let('r', pattern, whole))} AS text, "
           f"transform({found}, x -> k[x].kind) AS kinds))[0])[0])")
    changed = some.join(maps, [own, row], "left").select(*columns, F.explode(F.array(F.expr(put))).alias(done))
    number = f"map_from_entries(transform(array_distinct({done}.kinds), k -> struct(k, cast(size(filter({done}.kinds, x -> x = k)) AS bigint))))"
    changed = changed.withColumn("entities", F.expr(number)).withColumn(text, F.col(f"{done}.text")).select(*columns, "entities")
    clean = rows.where(~gate).select(*columns, F.expr("cast(map() AS map<string, bigint>)").alias("entities"))
    return clean.unionByName(changed)


def digest(out: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    kinds = [F.coalesce(F.col("entities")[k], F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *kinds)
