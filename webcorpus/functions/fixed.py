"""Lists and tables that must be exactly these for right results."""

import unicodedata

# Extensions that make a URL a document file.
DOCUMENT_EXTENSIONS = (
    ".pdf", ".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx", ".csv",
    ".odt", ".ods", ".odp", ".rtf", ".txt", ".json", ".xml",
)

# Extensions that may be delivered, with MIME type and display name.
DELIVERABLE_MIME = {
    ".md": "text/markdown",
    ".pdf": "application/pdf",
    ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xls": "application/vnd.ms-excel",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".txt": "text/plain",
}
DELIVERABLE_LABELS = {
    ".md": "Markdown",
    ".pdf": "PDF Document",
    ".doc": "Word Document",
    ".docx": "Word Document (Modern)",
    ".xls": "Excel Spreadsheet",
    ".xlsx": "Excel Spreadsheet (Modern)",
    ".txt": "Text Document",
}

# Image extensions that are never delivered, with display name.
IMAGE_LABELS = {
    ".png": "PNG Image",
    ".jpg": "JPEG Image",
    ".jpeg": "JPEG Image",
    ".gif": "GIF Image",
    ".bmp": "Bitmap Image",
    ".svg": "SVG Image",
    ".ico": "Icon File",
    ".webp": "WebP Image",
}

# Extension given to a file without one, by its content type.
CONTENT_TYPE_EXTENSIONS = {
    "application/pdf": ".pdf",
    "image/jpeg": ".jpg",
    "image/png": ".png",
    "text/plain": ".txt",
    "application/msword": ".doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/vnd.ms-excel": ".xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
    "application/zip": ".zip",
}

# Characters not allowed in a saved file's name.
FORBIDDEN_NAME_CHARS = r'[<>:"/\\|?*]'

# Link prefixes that are never followed, tags whose src may be a
# file, and the pattern of a CSS url(...) reference.
UNFOLLOWED_PREFIXES = ("#", "javascript:", "mailto:")
SRC_TAGS = ("img", "video", "audio", "source", "iframe")
CSS_URL = r"""url\(["']?([^"')]+)["']?\)"""

# Schemes whose last path segment may carry ;parameters (RFC 2396).
PARAM_SCHEMES = (
    "", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps",
    "sip", "sips", "mms", "sftp", "tel",
)

# RFC 3986 appendix B: 1 scheme, 2 netloc, 3 path, 4 query, 5 fragment.
URL_RE = "(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:[?]([^#]*))?(?:#(.*))?$"

# Latin letters that fold to more than one ASCII letter.
LATIN_DIGRAPHS = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th",
    "ĳ": "ij", "Ĳ": "IJ", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
}


def latin_fold() -> tuple[str, str]:
    """Latin letters with marks and the ASCII letter each folds to.

    Built from the Unicode decompositions of Latin-1 to Latin Extended-B and
    Additional and of the full-width forms, plus the few stroke letters that
    have no decomposition.
    """
    strokes = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H",
               "ŧ": "t", "Ŧ": "T", "ð": "d", "Ð": "D", "ı": "i"}
    pairs = dict(strokes)
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF10, 0xFF5B)]:
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base.isascii() and base.isalnum() and chr(code) not in LATIN_DIGRAPHS:
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


# The text summary, in the order in which its lines appear. %s, %d and %.2f stand for values.
SUMMARY = {
    "title": "=== UPLOAD STATISTICS SUMMARY ===",
    "generated": "Generated: %s",
    "to_process": "=== FILES TO PROCESS ===",
    "total_files": "Total files in %s directory: %d",
    "extensions": "=== FILE EXTENSIONS ===",
    "extension": "%s: %d files",
    "results": "=== UPLOAD RESULTS ===",
    "uploaded": "Successfully uploaded: %d",
    "failed": "Failed uploads: %d",
    "skipped": "Skipped files: %d",
    "processed": "Total files processed: %d",
    "rate": "Success rate for uploadable files: %.2f%%",
    "reasons": "=== FAILURE REASONS ===",
    "reason": "%s: %d files",
    "next": "=== NEXT STEPS ===",
    "retry": "To retry failed uploads, run the retry job.",
    "done": "All uploadable files were successfully processed!",
    "details": "Detailed results are available in the following files:",
    "csv": "- CSV Report: %s",
    "json": "- JSON Stats: %s",
    "logs": "- Full Logs: %s and %s",
}

# Columns of the CSV report, and what it calls the outcomes.
REPORT_COLUMNS = ("File Path", "Status", "Reason", "Response", "File Size (bytes)", "Upload Duration (s)")
REPORT_STATUS = {"success": "Success", "skipped": "Skipped", "failed": "Failed"}
REPORT_SKIPPED = "Unsupported or image file"
