"""Scan settings and the fixed tables they default to."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

# Named extension groups, content file names and limits. Results only
# agree with existing scan configurations when these are exactly as they are here.
EXTENSION_GROUPS: dict[str, tuple[str, ...]] = {
    "unix_shell": (".sh", ".bash", ".zsh", ".ksh", ".csh", ".tcsh", ".fish", ".ash"),
    "windows_shell": (".cmd", ".bat", ".ps1", ".psm1"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "typescript": (".ts", ".tsx"),
    "python": (".py",),
    "php": (".php",),
    "ruby": (".rb",),
    "go": (".go",),
    "java": (".java",),
    "c_cpp": (".c", ".cpp"),
    "csharp": (".cs", ".csx"),
    "vbnet": (".vb", ".vbs"),
    "rust": (".rs",),
    "lua": (".lua",),
    "perl": (".pl",),
    "swift": (".swift",),
    "config_misc": (".conf", ".config"),
}
CONTENT_FILES = (
    "package.json",
    "composer.json",
    "requirements.txt",
    "pyproject.toml",
    "Pipfile",
    "go.mod",
    "Cargo.toml",
    "pom.xml",
    "settings.xml",
    "web.xml",
    "applicationContext.xml",
    "hibernate.cfg.xml",
)
CONTENT_GROUPS = (
    "javascript", "typescript", "python", "php", "ruby", "go", "java",
    "c_cpp", "rust", "lua", "perl", "swift", "config_misc",
)
BLOCK_COMMENT_GROUPS = ("c_cpp", "javascript", "typescript", "java", "csharp", "php")
SCRIPT_GROUPS = ("javascript", "typescript")
PYTHON_EXTENSION = ".py"
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3}
TRUNCATION_MARK = " [truncated]"


@dataclass(frozen=True)
class ScanOptions:
    """Everything a scan can be told besides its packs and rules.

    ``exclude_mode='parent'`` drops a file only when its own directory is listed, which is
    what a walk that keeps descending does; ``'subtree'`` drops everything below as well.
    ``signature_gate`` takes pattern hits for enough: no line rule counts on a line that has one, and no file rule in
    a file that has one.

    ``context_column`` names a column of the files that holds each one's scan context; where it is null, ``scan_context`` holds.
    A file rule that names contexts applies in those, and where there is none.

    ``file_gate='documented'`` keeps only the first fallback file rule of a file, while
    ``'evaluated'`` keeps them all.
    """

    platform: str = "linux"
    level: str = "low"
    no_bail_out: bool = False
    all_matches: bool = False
    exclude_dirs: tuple[str, ...] = ()
    exclude_mode: str = "parent"
    file_gate: str = "evaluated"
    scan_context: str | None = None
    context_column: str | None = None
    signature_gate: bool = False
    max_line_length: int = 100
    max_line_rule_hit_length: int = 100
    max_lines_file_scan: int = 200
    max_chars_file_scan: int = 20_000
    max_preview_lines_file: int = 10
    max_minified_line_avg_length: int = 200
    extension_groups: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: EXTENSION_GROUPS)
    content_files: tuple[str, ...] = CONTENT_FILES
    content_groups: tuple[str, ...] = CONTENT_GROUPS

    def __post_init__(self):
        if self.level not in SEVERITY_RANK:
            raise ValueError(f"unknown severity level {self.level!r}")
        if self.exclude_mode not in ("parent", "subtree"):
            raise ValueError(f"unknown exclude mode {self.exclude_mode!r}")
        if self.file_gate not in ("evaluated", "documented"):
            raise ValueError(f"unknown file gate {self.file_gate!r}")

    def extensions(self, groups) -> list[str]:
        return [ext for group in groups for ext in self.extension_groups.get(group, ())]

    @property
    def shell_extensions(self) -> list[str]:
        return self.extensions(["windows_shell" if self.platform == "windows" else "unix_shell"])

    @property
    def content_extensions(self) -> list[str]:
        return self.extensions(self.content_groups)

    @property
    def block_comment_extensions(self) -> list[str]:
        return self.extensions(BLOCK_COMMENT_GROUPS)

    @property
    def script_extensions(self) -> list[str]:
        return self.extensions(SCRIPT_GROUPS)

    def forensic(self) -> "ScanOptions":
        """Whole files, no fallback gate."""
        return replace(self, no_bail_out=True, all_matches=True)
