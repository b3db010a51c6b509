"""Names of the C library and the word lists by which identifiers are grouped."""

from __future__ import annotations

# fmt: off
#: Families of library calls: all names, and those kept as they are.
FAMILIES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "API_ALLOC": ((
        "malloc", "calloc", "realloc", "alloca", "av_malloc", "av_mallocz", "av_calloc", "av_realloc", "av_reallocp", "av_realloc_f", "av_fast_realloc",
        "av_buffer_alloc", "av_buffer_allocz", "g_malloc", "g_malloc0", "g_malloc_n", "g_malloc0_n", "g_new", "g_new0", "g_renew", "g_try_malloc",
        "g_try_malloc0", "g_try_realloc", "qemu_malloc", "qemu_mallocz", "qemu_memalign", "qemu_blockalign", "kmalloc", "kzalloc", "kcalloc", "krealloc",
        "vmalloc", "vzalloc", "kvmalloc",
    ), ("malloc", "calloc", "realloc")),
    "API_FREE": (("free", "av_free", "av_freep", "g_free", "qemu_free", "kfree", "vfree", "kvfree"), ("free",)),
    "API_UNREF": ((
        "av_buffer_unref", "av_frame_unref", "av_packet_unref", "av_frame_free", "av_packet_free", "av_dict_free", "avformat_close_input", "avcodec_close",
        "avcodec_free_context", "sws_freeContext", "swr_free", "avfilter_graph_free", "object_unref", "g_object_unref", "qobject_unref", "blk_unref",
        "bdrv_unref",
    ), ()),
    "API_REF": (("av_buffer_ref", "av_frame_ref", "av_packet_ref", "object_ref", "g_object_ref", "qobject_ref"), ()),
    "API_STRDUP": (("strdup", "strndup", "av_strdup", "av_strndup", "av_asprintf", "g_strdup", "g_strndup", "g_strdup_printf", "g_strconcat", "qemu_strdup", "wcsdup"), ("strdup", "strndup")),
    "API_COPY": (("memcpy", "memmove", "strcpy", "strncpy", "strlcpy", "bcopy", "wmemcpy", "wcscpy", "wcsncpy"), ("memcpy", "memmove", "strcpy", "strncpy")),
    "API_CONCAT": (("strcat", "strncat", "strlcat", "wcscat", "wcsncat"), ("strcat", "strncat")),
    "API_SET": (("memset", "bzero", "wmemset"), ("memset",)),
    "API_FORMAT": (("sprintf", "snprintf", "vsprintf", "vsnprintf", "asprintf", "vasprintf", "printf", "fprintf", "vprintf", "vfprintf", "syslog"), ("sprintf", "snprintf", "printf", "fprintf")),
    "API_IO_READ": ((
        "read", "fread", "pread", "recv", "recvfrom", "recvmsg", "readv", "fgets", "gets", "getchar", "getc", "fgetc", "getline", "getdelim", "scanf", "fscanf",
        "sscanf", "vscanf", "vfscanf", "vsscanf",
    ), ("read", "fread", "recv", "recvfrom", "gets", "fgets", "getchar", "scanf", "fscanf", "sscanf")),
    "API_IO_WRITE": (("write", "fwrite", "pwrite", "send", "sendto", "sendmsg", "writev", "puts", "fputs"), ("write", "fwrite", "send", "sendto")),
    "API_FILE": (("fopen", "open", "fclose", "close", "mmap", "access", "chmod", "chown", "stat", "lstat", "mkdir", "rmdir", "unlink", "rename", "realpath", "readlink"), ("fopen", "fclose", "open", "close", "mmap")),
    "API_EXEC": (("system", "popen", "pclose", "execl", "execle", "execlp", "execv", "execve", "execvp", "execlpe", "execvpe"), ("system", "popen", "execve")),
    "API_CONVERT": (("atoi", "atol", "atoll", "atof", "strtol", "strtoul", "strtoll", "strtoull", "strtod", "strtof"), ("atoi", "atol", "strtol", "strtoul")),
    "API_STRLEN": (("strlen", "strnlen", "wcslen"), ("strlen",)),
    "API_STRCMP": (("strcmp", "strncmp", "strcasecmp", "strncasecmp", "memcmp"), ("strcmp", "strncmp", "memcmp")),
    "API_STRCHR": (("strchr", "strrchr", "strstr", "strpbrk", "strcspn", "strspn", "memchr", "strtok", "wcstok"), ("strchr", "strstr")),
    "API_ENV": (("getenv", "setenv", "putenv", "getcwd", "getwd"), ()),
    "API_TEMP": (("tmpnam", "tempnam", "mktemp", "tmpfile", "mkstemp", "mkostemp"), ()),
}
#: Calls kept as they are besides those of the families: risky ones, and their safe forms.
RISKY = (
    "gets", "strcpy", "strcat", "sprintf", "vsprintf", "scanf", "sscanf", "fscanf", "system", "popen", "execve", "execl", "execv", "mktemp", "tmpnam",
    "tempnam", "memcpy", "memmove", "wcscpy", "wcscat", "realpath", "getwd", "getcwd",
)
SAFE = ("snprintf", "vsnprintf", "strncpy", "strlcpy", "strncat", "strlcat", "fgets", "getline", "memcpy_s", "strcpy_s", "strncpy_s", "strcat_s")
#: Defensive calls by name, then by what a lower-cased name holds, in order.
DEFENCES = {
    "DEF_ASSERT": ("assert", "static_assert", "ASSERT", "BUG_ON", "WARN_ON"),
    "DEF_BOUNDS": ("bounds_check", "range_check", "size_check", "length_check"),
    "DEF_SAFE": ("snprintf", "strlcpy", "strlcat", "memcpy_s", "memmove_s", "memset_s"),
    "DEF_ERROR": ("perror", "strerror"),
}
DEFENCE_PARTS = [("DEF_CHECK", ("check", "valid", "verify")), ("DEF_SANITIZE", ("sanit", "escape", "filter")), ("DEF_BOUNDS", ("bound", "range", "limit")), ("DEF_SAFE", ("safe_", "_safe"))]
DEFENCE_WORDS = ("check", "valid", "verify", "sanit", "bound", "range", "safe", "assert")
KEYWORDS = (
    "auto", "break", "case", "char", "const", "continue", "default", "do", "double", "else", "enum", "extern", "float", "for", "goto", "if", "inline", "int",
    "long", "register", "restrict", "return", "short", "signed", "sizeof", "static", "struct", "switch", "typedef", "union", "unsigned", "void", "volatile",
    "while", "_Bool", "_Complex", "_Imaginary", "NULL", "true", "false", "nullptr", "uint8_t", "uint16_t", "uint32_t", "uint64_t", "int8_t", "int16_t",
    "int32_t", "int64_t", "size_t", "ssize_t", "ptrdiff_t", "intptr_t", "uintptr_t", "off_t", "time_t", "pid_t", "uid_t", "gid_t", "socklen_t", "mode_t",
    "dev_t", "ino_t", "nlink_t", "blksize_t", "blkcnt_t", "clock_t", "useconds_t", "suseconds_t",
)
TYPE_WORDS = (
    "void", "char", "short", "int", "long", "signed", "unsigned", "float", "double", "uint8_t", "uint16_t", "uint32_t", "uint64_t", "int8_t", "int16_t",
    "int32_t", "int64_t", "size_t", "ssize_t", "ptrdiff_t", "intptr_t", "uintptr_t", "off_t", "time_t", "pid_t", "uid_t", "gid_t", "socklen_t", "mode_t",
    "dev_t", "ino_t", "nlink_t", "blksize_t", "blkcnt_t", "clock_t", "useconds_t", "suseconds_t",
)
#: Meaning of an identifier by its parts, in order of precedence.
BUCKETS = {
    "BUF": (
        "buf", "buffer", "dst", "src", "data", "str", "string", "payload", "msg", "packet", "input", "output", "dest", "source", "out", "tmp", "scratch",
        "line", "name", "text", "content",
    ),
    "LEN": ("len", "length", "size", "sz", "count", "cnt", "num"),
    "CAP": ("cap", "capacity", "limit", "max", "min", "avail", "remaining", "rem", "bound", "alloc"),
    "PTR": ("ptr", "pointer", "head", "tail", "node", "cursor", "iter", "next", "prev", "current", "cur"),
    "IDX": ("idx", "index", "pos", "offset", "off", "ofs", "start", "end"),
    "RET": ("ret", "result", "rv", "rc", "status", "code"),
    "ERR": ("err", "error", "errno", "fail", "failure"),
    "FD": ("fd", "fp", "file", "path", "filename", "filepath", "dir", "directory", "handle", "stream"),
    "CMD": ("cmd", "command", "arg", "args", "argv", "argc", "env", "param"),
    "FLAGS": ("flags", "flag", "mode", "mask", "opt", "options", "attr", "type"),
    "SENS": (
        "password", "passwd", "pwd", "secret", "token", "credential", "cred", "auth", "session", "cookie", "key", "cert", "private", "hash", "salt", "nonce",
        "iv", "encrypt", "decrypt",
    ),
    "PRIV": ("admin", "root", "user", "privilege", "priv", "permission", "perm", "role", "access", "owner", "group", "uid", "gid", "sudo"),
    "MEM": ("mem", "memory", "heap", "stack", "block", "chunk", "pool", "cache"),
    "CTX": ("ctx", "context", "state", "info", "config", "cfg", "setting"),
}
LETTERS = {"p": "PTR", "n": "LEN", "i": "IDX", "j": "IDX", "k": "IDX", "s": "BUF", "c": "VAR", "x": "VAR", "y": "VAR", "m": "VAR"}
#: Numbers kept as they are.
KEPT_HEX = ("0x0", "0x1", "0xff", "0xffff", "0xffffffff", "0x7fffffff", "0x80", "0x7f", "0x20", "0x00")
KEPT_OCTAL = ("0644", "0600", "0755", "0777", "0666", "0700", "0400")
KEPT_BOUNDS = ("255", "1023", "4095", "65535", "2147483647", "4294967295", "100", "200", "500", "1000")
#: Tokens after which a minus is a sign.
BEFORE_SIGN = (
    "=", "==", "!=", "<", ">", "<=", ">=", "(", ",", "return", "?", ":", "case", "+", "-", "*", "/", "%", "&", "|", "^", "&&", "||", "<<", ">>", "[", "{", ";",
)
# fmt: on
