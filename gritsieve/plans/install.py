"""Git hooks as files: where they go, what they run, and which of them are ours to replace or remove."""

from __future__ import annotations

import os
import subprocess
import sys
from collections.abc import Callable, Mapping
from pathlib import Path

from ..functions.text import shell_quoted
from .hooks import HookOptions

MARK = "# Installed by gritsieve"
SHELLS = ("bash", "zsh", "fish", "posix")


class HookError(Exception):
    pass


def _git(*arguments: str, cwd: str = ".") -> tuple[int, str]:
    done = subprocess.run(["git", *arguments], cwd=cwd, capture_output=True, text=True)
    return done.returncode, (done.stdout if done.returncode == 0 else done.stderr).strip()


def script(options: HookOptions, python: str = sys.executable) -> str:
    """A hook that leaves the check to this package."""
    given = {"--allowed-repos": options.allowed_repos, "--blocked-repos": options.blocked_repos, "--exclude": options.exclude}
    words = [python, "-m", "gritsieve", "check", options.hook_type, *(w for flag, value in given.items() if value is not None for w in (flag, value))]
    root = shell_quoted(str(Path(__file__).resolve().parents[2]))
    return f'#!/bin/sh\n{MARK}\nPYTHONPATH={root}"${{PYTHONPATH:+:$PYTHONPATH}}" exec {" ".join(map(shell_quoted, words))}\n'


def local_folder(repository: str = ".") -> Path:
    code, said = _git("rev-parse", "--path-format=absolute", "--git-path", "hooks", cwd=repository)
    if code or not said:
        raise HookError(f"a local hook needs a git repository: {said}")
    return Path(said)


def own_global_folder(variables: Mapping[str, str]) -> Path:
    """Where global hooks go if git names no folder: below the first of the user's configuration folders that is set."""
    homes = (("XDG_CONFIG_HOME", ""), ("HOME", ".config"), ("APPDATA", ""), ("USERPROFILE", ".config"))
    found = next((Path(variables[name]) / below for name, below in homes if variables.get(name)), None)
    if found is None:
        raise HookError("no home folder for global hooks: set HOME or XDG_CONFIG_HOME")
    return found / "gritsieve" / "hooks"


def global_folder() -> Path | None:
    """The folder of core.hooksPath in git's global configuration."""
    code, said = _git("config", "--global", "--type=path", "--get", "core.hooksPath")
    return Path(said) if not code and said else None


def _ours(path: Path, action: str) -> None:
    try:
        foreign = path.exists() and MARK not in path.read_text(encoding="utf-8")
    except (OSError, UnicodeDecodeError) as e:
        raise HookError(f"can't read the hook at '{path}': {e}") from e
    if foreign:
        raise HookError(f"won't {action} the hook at '{path}', which is not ours: merge or remove it by hand")


def install(options: HookOptions, everywhere: bool = False, repository: str = ".", say: Callable[[str], None] = print) -> Path:
    """Writes the hook, for one repository or for all of the user; a hook of someone else's stays."""
    folder = global_folder() if everywhere else local_folder(repository)
    unset = folder is None
    folder = folder or own_global_folder(os.environ)
    path = folder / options.hook_type
    _ours(path, "overwrite")
    folder.mkdir(parents=True, exist_ok=True)
    path.write_text(script(options), encoding="utf-8", newline="")
    path.chmod(0o755)
    if unset:
        code, said = _git("config", "--global", "core.hooksPath", str(folder))
        if code:
            raise HookError(f"git can't be told of '{folder}': {said}")
        say(f"git's global core.hooksPath is now {folder}")
    say(f"Installed {options.hook_type} hook at {path}")
    return path


def uninstall(hook_type: str, everywhere: bool = False, repository: str = ".", say: Callable[[str], None] = print) -> bool:
    """Removes our hook; whether there was one."""
    folder = (global_folder() or own_global_folder(os.environ)) if everywhere else local_folder(repository)
    path = folder / HookOptions(hook_type).hook_type
    if not path.exists():
        say(f"No {hook_type} hook at {path}")
        return False
    _ours(path, "remove")
    path.unlink()
    say(f"Removed {hook_type} hook at {path}")
    return True


def shell_aliases(shell: str, python: str = sys.executable) -> str:
    """A short name for the command, in a shell's own syntax."""
    if shell not in SHELLS:
        raise ValueError(f"shell {shell!r}")
    command = shell_quoted(f"{python} -m gritsieve")
    return "".join(f"alias {name}{' ' if shell == 'fish' else '='}{command}\n" for name in ("gritsieve", "gs"))


def verify(path: str | Path, say: Callable[[str], None] = print) -> bool:
    """Tells a program file's size, and warns if anyone may write it; no digest is taken."""
    state = Path(path).stat()
    safe = not state.st_mode & 0o002
    if not safe:
        say(f"WARNING: anyone may write {path}")
    say(f"{path}: {state.st_size} bytes")
    return safe
