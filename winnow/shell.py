"""Interactive shell over the command line's functions; it keeps the last scan."""

from __future__ import annotations

import argparse
import cmd
import os
import shlex
from pathlib import Path

from winnow import cli
from winnow.engine import Engine
from winnow.operators import groups
from winnow.plans import report


class Shell(cmd.Cmd):
    prompt = "winnow> "

    def __init__(self, engine: Engine, options: argparse.Namespace, ask=input):
        super().__init__()
        self.engine, self.options, self.ask = engine, options, ask
        self.files = self.fuzzy = None  # the last scan and its fuzzy groups

    def _words(self, line: str) -> list[str] | None:
        try:
            return shlex.split(line)
        except ValueError as e:
            print(f"[!] {e}")
            return None

    def _options(self, command: str, line: str) -> argparse.Namespace | None:
        """The shell's settings with a line's own; bad ones are told, not fatal."""
        words = self._words(line)
        if words is None:
            return None
        held = argparse.Namespace(**vars(self.options))
        held.exclude = list(self.options.exclude)
        held.paths = []
        try:
            return cli.parser().parse_args([command, *words], held)
        except SystemExit:
            return None

    def do_scan(self, line: str) -> None:
        """scan [folder ...] [options]: exact groups, with --fuzzy also probable ones."""
        a = self._options("scan", line)
        if a is None:
            return
        good = [p for p in a.paths if Path(p).expanduser().is_dir()]
        for p in a.paths:
            if p not in good:
                print(f"[!] Skipping invalid path: {p}")
        a.paths = good or ["."]
        self.files = cli.scan(self.engine, a)
        for text in report.FORMATS[a.format](self.files):
            print(text)
        if a.fuzzy:
            self._fuzzy(a)

    def _fuzzy(self, a: argparse.Namespace) -> None:
        self.fuzzy = cli.fuzzy_rows(self.engine, self.files, a)
        for text in report.text_fuzzy(self.fuzzy):
            print(text)

    def _scanned(self) -> bool:
        if self.files is None:
            print("[!] No scan results. Run 'scan <path>' first.")
        return self.files is not None

    def do_fuzzy(self, line: str) -> None:
        """fuzzy [--tolerance s] [--ratio r] [--frames n] [--threshold d]: probable copies in the last scan."""
        words = self._words(line)
        if words is None or not self._scanned():
            return
        names = {"--tolerance": "--fuzzy-tolerance", "--ratio": "--fuzzy-tolerance-ratio", "--frames": "--fuzzy-frames", "--threshold": "--fuzzy-threshold"}
        a = self._options("scan", shlex.join(names.get(w, w) for w in words))
        if a is not None:
            self._fuzzy(a)

    def _clean(self, command: str, line: str) -> None:
        a = self._options(command, line)
        if a is not None and self._scanned():
            cli.clean_files(self.engine, self.files, a, self.ask)

    def do_clean(self, line: str) -> None:
        """clean [--strategy s] [--apply] [--no-trash] [--interactive] [--yes]: over the last scan's groups."""
        self._clean("clean", line)

    def do_fuzzyclean(self, line: str) -> None:
        """fuzzyclean [--strategy s] [--apply]: over the last scan's probable copies; YES has to be typed."""
        self._clean("fuzzyclean", line)

    def do_export(self, line: str) -> None:
        """export <file.json|file.csv|file>: the last scan's report."""
        words = self._words(line)
        if words and self._scanned():
            report.write_report(self.files, words[0])
            print(f"[+] Report saved to: {words[0]}")

    def do_exclude(self, line: str) -> None:
        """exclude <pattern> | --list | --clear"""
        pattern = line.strip().strip("\"'")
        if pattern == "--clear":
            self.options.exclude.clear()
        elif pattern and pattern != "--list":
            self.options.exclude.append(pattern)
        print("[*] Exclude patterns: " + (", ".join(self.options.exclude) or "none"))

    def do_workers(self, line: str) -> None:
        """workers [n]: cores of the next session."""
        if line.strip().isdigit():
            self.options.workers = line.strip()
        print(f"[*] Workers: {self.options.workers}")

    def do_cache(self, line: str) -> None:
        """cache [folder | --off]"""
        if line.strip():
            self.options.cache = "" if line.strip() == "--off" else line.strip().strip("\"'")
        print(f"[*] Cache: {self.options.cache or '(disabled)'}")

    def do_cd(self, line: str) -> None:
        """cd <folder>"""
        try:
            os.chdir(Path(line.strip().strip("\"'") or "~").expanduser())
        except OSError as e:
            print(f"[!] {e}")

    def do_pwd(self, line: str) -> None:
        """pwd"""
        print(os.getcwd())

    def do_totals(self, line: str) -> None:
        """totals: groups and waste of the last scan"""
        if self._scanned():
            print(groups.totals(groups.group_metrics(self.files)).first())

    def do_exit(self, line: str) -> bool:
        """exit"""
        return True

    do_quit = do_EOF = do_exit
