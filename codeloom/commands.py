"""Command lines of the interactive shell: ``name argument … key=value``."""

from __future__ import annotations

import shlex
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Command:
    name: str = ""
    args: list[str] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)


def parse_command(line: str) -> Command:
    """The command of a line: its name in lower case, arguments in order, and ``key=value``, ``-key=value`` or ``--key=value``
    as options, the last of one key counting. Quotes keep blanks together; an open quote is an error; a blank line is empty."""
    words = shlex.split(line)
    if not words:
        return Command()
    args, options = [], {}
    for word in words[1:]:
        key, equals, value = word.partition("=")
        bare = key.lstrip("-")
        if equals and bare and len(key) - len(bare) <= 2:
            options[bare] = value
        else:
            args.append(word)
    return Command(words[0].lower(), args, options)


def format_command(command: Command) -> str:
    """A line that parses to the command again; options in order of their keys."""
    if not command.name:
        return ""
    return " ".join([command.name, *map(shlex.quote, command.args), *(shlex.quote(f"--{k}={v}") for k, v in sorted(command.options.items()))])
