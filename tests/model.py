"""A small sequential model of the cascade, written to check the Spark plans; not part of the package."""

from __future__ import annotations

import random
import re

from logveil.functions.rules import UNIQUE, Catalogue, pseudonym_format


class Model:
    def __init__(self, catalogue: Catalogue | None = None):
        self.catalogue = catalogue or Catalogue.builtin()
        self.compiled = {r.rule_id: re.compile(r.pattern, re.I if r.ignore_case else 0) for r in self.catalogue}

    def _number(self, dictionary, category, original):
        known = dictionary.setdefault(category, {})
        return known.setdefault(original, len(known) + 1)

    def _apply(self, rule, text, hits, dictionary, line_no):
        position = 0

        def replaced(match):
            nonlocal position
            position += 1
            prefix = next((g for g in match.groups() if g), "") if rule.keeps_prefix else ""
            original = match.group(0)[len(prefix):]
            hits.append((line_no, rule.rule_id, rule.category, position, original))
            if not rule.is_unique:
                return prefix + rule.literal
            before, width, after = pseudonym_format(rule.category)
            number = str(self._number(dictionary, rule.category, original)).zfill(width)
            return prefix + rule.literal.replace(UNIQUE, before + number + after)
        return self.compiled[rule.rule_id].sub(replaced, text)

    def redact(self, text, dictionary=None):
        """``(text, hits)``, ids in order of first appearance."""
        hits, dictionary = [], {} if dictionary is None else dictionary
        lowered = text.lower()
        has_keyword = any(k in lowered for k in self.catalogue.keywords)
        for rule in self.catalogue.text_rules:
            if any(k in lowered for k in rule.keywords):
                text = self._apply(rule, text, hits, dictionary, None)
        if has_keyword:
            text = text.replace("\r\n", "\n")
        lines = []
        for line_no, line in enumerate(text.split("\n"), 1):
            low = line.lower()
            for rule in self.catalogue.line_rules:
                if any(k in low for k in rule.keywords):
                    line = self._apply(rule, line, hits, dictionary, line_no)
            lines.append(line)
        return "\n".join(lines), hits


FRAGMENTS = [
    "user=", "user = ", "user: ", "username=", '"user":"', '"login" : "', "login=", "john", "john.smith@company.com",
    "a@b.com", "x@y.com.corp", "@", "a@b.com_x@c.com", "10.0.0.1", "192.168.1.100", "172.16.0.9", "10.0.0.1.corp", "8.8.8.8",
    "server.corp", "x.y.local", "server10.local", "java.lang.X", "password=", "pwd: ", "secret=", '"password":"', "token=",
    '"token":"', "api_key:", "apikey = ", "bearer ", "abcdefghij1234567890", "abcdefghij-", "-klmnopqrst", '"', '"}', ",", ";",
    " ", " ", " ", "  ", "/", "/t/", "/vizql/w/", "/v/", "/views/", "/authoring/", "?x", "#", "site=", "site = ", "workbook:",
    '"wb":"', "vw=", "datasource=", "project ", "Server=", "Data Source=", "uid=", "User ID =", "jdbc:mysql://db:1/x",
    "\\\\srv\\share\\a", "\\", "123-45-6789", "00:1A:2B:3C:4D:5E", "00-1a-2b-3c-4d-5e", ":", "-", "=", "Foo", "Bar Baz",
    "Authorization: Bearer ", "Authorization:Basic x", "HTTP/1.1", "entity001", "user001@redacted.com", "{", "\t", "\x01",
    "\x03", "\x04", "0\x01email=61\x020", "é", "ß@ä.de",
]
BLOCK_LINES = [
    "SELECT a", "select b from c", "  FROM t", "FROM t", ") x", "INSERT INTO t", "UPDATE t SET", "update the docs", "WITH x AS (",
    "  indented", "plain", "", "WHERE a = 1", "DELETE FROM t", "\tVALUES (1)", "-----BEGIN RSA PRIVATE KEY-----", "MIIE",
    "-----END RSA PRIVATE KEY-----", "a -----BEGIN CERTIFICATE-----", "-----END CERTIFICATE----- b", "OR mail=a@b.com", "ON x",
    "-----BEGIN PRIVATE KEY-----x-----END PRIVATE KEY-----",
]


def random_line(rng: random.Random) -> str:
    return "".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(0, 12)))


def random_document(rng: random.Random, blocks: bool = True) -> str:
    lines = [rng.choice(BLOCK_LINES) if blocks and rng.random() < 0.3 else random_line(rng)
             for _ in range(rng.randint(0, 12))]
    return ("\r\n" if rng.random() < 0.1 else "\n").join(lines) + ("\n" if rng.random() < 0.3 else "")
