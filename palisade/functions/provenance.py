"""Which tool results come from outside: routing by tool, trusted commands, written paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tools by group, commands that fetch, and commands that only report on own work.
SKIPPED = [
    "annotate_preview", "apply_layout", "browser_vault_enter_code", "browser_vault_fill", "browser_vault_list", "browser_vault_save_login",
    "browser_vault_unlock", "clarify", "close_preview", "close_terminal", "cronjob_manage", "desktop_project", "focus_pane", "gui_tour",
    "image_generate", "manage_connections", "memory", "open_preview", "patch", "react_to_message", "send_message", "show_tip", "skill_manage",
    "skills_list", "text_to_speech", "todo", "todo_list", "video_generate", "write_file",
]
FIRST_PARTY = ["honcho_ask", "honcho_profile", "honcho_search", "session_search", "skill_view", "tool_describe", "tool_search"]
EXTERNAL = [
    "browser_back", "browser_cdp", "browser_click", "browser_console", "browser_dialog", "browser_exec", "browser_get_images", "browser_navigate",
    "browser_press", "browser_scroll", "browser_snapshot", "browser_type", "browser_vision", "computer_use", "feishu_doc_read", "video_analyze",
    "vision_analyze", "web_extract", "web_search", "x_search",
]
LOCAL_FILES = ["read_file", "search_files"]
SOURCE_COMMAND = (
    r"imap\.js|himalaya|\bcurl\b|\bwget\b|\bnak\b|websocat|wss?://|https?://|yt-dlp|\bgh\b|lynx|w3m|notmuch|\bmu\s+(?:find|view)|\bxh\b|\bhttps?\s+(?:get|post)\b"
)
SOURCE_CODE = r"\b(?:requests|urllib|httpx|aiohttp|imaplib|poplib|socket|feedparser|websockets?)\b"
TRUSTED_COMMANDS = ["cd", "chmod", "cp", "date", "df", "du", "echo", "hostname", "id", "ln", "mkdir", "mv", "printf", "pwd", "rm", "sleep", "touch", "true", "uptime", "wc", "which", "whoami"]
TRUSTED_GIT = ["add", "branch", "checkout", "commit", "init", "restore", "rev-parse", "stash", "status", "switch", "tag"]
OUTPUT_ARGUMENT = r"""(?:^|\s)(?:-o|-O|--output|--output-document|-P|--directory-prefix)(?:=|\s+)(['"]?)([^\s'";|&<>]+)\1"""
REDIRECT = r"""(?:>>?|\|\s*tee(?:\s+-a)?)\s*(['"]?)([^\s'";|&<>]+)\1"""


def is_source_command(command: Column) -> Column:
    return command.rlike("(?i)" + SOURCE_COMMAND)


def is_source_code(code: Column) -> Column:
    return is_source_command(code) | code.rlike(SOURCE_CODE)


def is_trusted_command(command: Column, extra: list[str] | None = None) -> Column:
    """Every segment of the command is of the trusted ones; a command without words is trusted only if
    it is not blank."""
    segments = F.split(F.regexp_replace(command, r"\d*>&\d+", " "), r"&&|\|\||[;|&\n]")
    # leading NAME=value words are dropped
    bare = F.transform(segments, lambda s: F.regexp_replace(F.regexp_replace(s, r"^\s+|\s+$", ""), r"^(?:\w+=\S*(?:\s+|$))+", ""))
    names = lambda s: F.regexp_extract(F.split(s, r"\s+")[0], r"([^/]*)$", 1)
    sub = lambda s: F.coalesce(F.get(F.filter(F.slice(F.split(s, r"\s+"), F.lit(2), F.char_length(s)), lambda w: ~w.startswith("-")), F.lit(0)), F.lit(""))
    fine = lambda s: (s == "") | F.when(names(s) == "git", sub(s).isin(TRUSTED_GIT)).otherwise(names(s).isin([*TRUSTED_COMMANDS, *(extra or [])]))
    return (F.trim(command) != "") & ~command.rlike(r"\$\(|`|<\(") & F.forall(bare, fine)


def under(path: Column, root: Column) -> Column:
    """path is root or inside it; a root that is not absolute matches by suffix."""
    absolute = (path == root) | path.startswith(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/")))
    return F.when(root.startswith("/"), absolute).otherwise((path == root) | path.endswith(F.concat(F.lit("/"), root)))


def written_paths(command: Column) -> Column:
    """The paths that a fetching command writes; a URL is saved under its last segment."""
    targets = F.concat(F.regexp_extract_all(command, F.lit(OUTPUT_ARGUMENT), F.lit(2)), F.regexp_extract_all(command, F.lit(REDIRECT), F.lit(2)))
    targets = F.filter(targets, lambda t: ~t.startswith("/dev/") & ~t.startswith("&"))
    last = lambda t: F.regexp_extract(F.regexp_replace(F.regexp_replace(t, r"\?.*$", ""), "/+$", ""), r"([^/]*)$", 1)
    return F.filter(F.transform(targets, lambda t: F.when(t.rlike("(?i)^https?://"), last(t)).otherwise(t)), lambda t: t != "")


def mode(tool: Column, command: Column, external_path: Column, external_session: Column, skip: list[str] | None = None, warn: list[str] | None = None, trusted: list[str] | None = None) -> Column:
    """null (not scanned), warn, external, local or other: the first rule that holds."""
    return (
        F.when(tool.isin([*SKIPPED, *(skip or [])]), F.lit(None).cast("string"))
        .when(tool.isin([*FIRST_PARTY, *(warn or [])]), "warn")
        .when(tool.startswith("mcp_") | tool.isin(EXTERNAL) | (tool.startswith("browser_") & ~tool.contains("vault")), "external")
        .when(tool == "terminal", F.when(is_source_command(command), "external").when(is_trusted_command(command, trusted), "warn").otherwise("local"))
        .when(tool == "execute_code", F.when(is_source_code(command), "external").otherwise("local"))
        .when(tool == "process_manage", F.when(external_session, "external").otherwise("local"))
        .when(tool.isin(LOCAL_FILES), F.when(external_path, "external").otherwise("local"))
        .otherwise("other")
    )
