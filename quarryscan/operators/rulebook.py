"""The rule catalogue: one row per rule, patterns for Java's regular expressions.

Identifiers of evidenced rules are fixed values; patterns and titles are this project's own. `QS-SEC-…` rules have no counterpart
elsewhere. `ignore` names the predicates of `rules.IGNORES` that drop a match.
"""

from __future__ import annotations

from dataclasses import dataclass

INFO, LOW, MEDIUM, HIGH, CRITICAL = range(5)
# Categories in the order of their ordinals.
CATEGORIES = ("Secrets", "Dependencies", "Network", "Auth", "CodeSafety", "BinaryHygiene", "Maintainability")
CATEGORY_LABELS = ("Credentials", "Dependencies", "Network", "Access control", "Code safety", "Binary hygiene", "Maintainability")
# Capabilities in the order of their ordinals.
CAPABILITIES = ("BrowserCredentials", "BrowserCookies", "CryptocurrencyWallets", "ChatTokens", "ClipboardMonitoring", "StartsWithWindows", "DownloadsAndRunsCode")
FAMILIES = {
    "SEC": "Credentials in the files", "MAL": "Behaviour of malicious software", "CFG": "Unsafe configuration", "CODE": "Unsafe code",
    "INPUT": "Unchecked input", "PKG": "Packaging", "BIN": "Binaries", "DEP": "Dependencies", "DUP": "Duplication", "PUR": "Stated purpose", "AI": "Model findings",
}


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    category: str
    severity: int
    user_severity: int
    pattern: str
    ignore: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    is_blocking: bool = False
    capability: str | None = None
    is_capability: bool = False
    #: The group of the pattern that holds the secret; 0 for the whole match, None for none.
    secret_group: int | None = None
    most: int = 20
    #: A pattern that the path must match, if any.
    path_filter: str | None = None


def _mal(number: int, title: str, pattern: str, capability: str | None, ignore: tuple[str, ...] = ()) -> Rule:
    return Rule(f"VC-MAL-{number:03d}", title, "CodeSafety", CRITICAL, CRITICAL, pattern, ignore, is_blocking=True, capability=capability)


def _able(number: int, title: str, pattern: str, capability: str, ignore: tuple[str, ...] = ()) -> Rule:
    return Rule(f"VC-MAL-{number:03d}", title, "CodeSafety", INFO, INFO, pattern, ignore, capability=capability, is_capability=True)


_PASSWORD = r"passw(?:or)?d|passphrase|\bpwd\b"
_FAST = r"\b(?:md5|sha-?1)\b|md5create|sha1create|md5\.|sha1\."
_SQL = r"(?:select\b[^\n\"'`;]{1,120}?\bfrom\b|insert\s+into\b|update\b[^\n\"'`;]{1,80}?\bset\b|delete\s+from\b)"
_BROWSER = r"(?:chrome|chromium|edge|brave|opera|vivaldi|firefox|mozilla|user\s+data)"
_WALLET_ADDRESS = r"(?:\bbc1|\[13\]\[|0x\[a-f|\b0x[a-f0-9]{40}\b|\b[13][1-9a-km-z]{25,34}\b)"

RULES: tuple[Rule, ...] = (
    # Behaviour
    _mal(1, "Reads passwords saved by a browser", rf"(?mdi){_BROWSER}[^\n]{{0,80}}?login\s+data\b|\blogin\s+data\b[^\n]{{0,80}}?(?:logins?\b|password_value)|\bkey[34]\.db\b|\blogins\.json\b", "BrowserCredentials", ("pattern_text",)),
    _mal(2, "Reads cookies kept by a browser", rf"(?mdi){_BROWSER}[^\n]{{0,80}}?(?:network[\\/]+)?[\\/]cookies\b|\bcookies\.sqlite\b|\bfrom\s+moz_cookies\b", "BrowserCookies", ("pattern_text",)),
    _mal(3, "Reads files of a cryptocurrency wallet", r"(?mdi)\bwallet\.dat\b|exodus[\\/]+exodus\.wallet|electrum[\\/]+wallets|atomic[\\/]+local\s+storage|nkbihfbeogaeaoehlefnkodbefgpgknn|ethereum[\\/]+keystore", "CryptocurrencyWallets", ("pattern_text",)),
    _mal(4, "Reads sign-in tokens of a chat program", r"(?mdi)(?:discord(?:canary|ptb)?|telegram\s+desktop|slack|signal)\b[^\n]{0,80}?(?:\btokens?\b|leveldb|tdata)", "ChatTokens", ("pattern_text",)),
    _mal(5, "Watches the clipboard for wallet addresses", rf"(?mdi)(?:getclipboard|clipboard\.(?:gettext|readtext|get|paste)|pyperclip)[\s\S]{{0,120}}?{_WALLET_ADDRESS}|{_WALLET_ADDRESS}[\s\S]{{0,120}}?(?:getclipboard|clipboard\.(?:gettext|readtext|get|paste)|pyperclip)", "ClipboardMonitoring", ("pattern_text",)),
    _able(6, "Registers itself to start at sign-in", r"(?mdi)currentversion(?:\\{1,2}|/)run(?:once)?\b|start\s+menu(?:\\{1,2}|/)programs(?:\\{1,2}|/)startup|schtasks(?:\.exe)?[^\n]{0,40}?/create|setloginitemsettings|library/launchagents", "StartsWithWindows", ("pattern_text",)),
    _able(7, "Fetches a program and starts it", r"(?mdi)\bprocess\.start\s*\(|\bshellexecute(?:ex)?\s*\(|\bchild_process\.(?:exec|execfile|spawn|fork)\s*\(|\bsubprocess\.(?:run|popen|call)\s*\(|\bos\.startfile\s*\(", "DownloadsAndRunsCode", ("no_download", "pattern_text")),
    _mal(8, "Runs fetched content through a system utility", r"(?mdi)\bcertutil\b[^\n]{0,60}?[-/](?:urlcache|decode)\b|\bbitsadmin\b[^\n]{0,60}?/transfer\b|\bmshta\b[^\n]{0,20}?(?:https?:|javascript:|vbscript:)|\bregsvr32\b[^\n]{0,60}?/i:https?:|\b(?:iex|invoke-expression)\b[^\n]{0,80}?(?:downloadstring|net\.webclient|invoke-webrequest)|\b(?:curl|wget)\b[^\n|]{0,160}\|\s*(?:ba|z|k)?sh\b", None, ("pattern_text",)),
    # Configuration
    Rule("VC-CFG-001", "Database rules let everybody in", "Auth", CRITICAL, HIGH, r"(?mdi)\ballow\s+[a-z,\s]{2,60}?:\s*if\s+true\b|[\"']\.(?:read|write)[\"']\s*:\s*(?:true\b|[\"']true[\"'])"),
    Rule("VC-CFG-002", "Node integration is on in a renderer", "CodeSafety", HIGH, HIGH, r"(?mdi)\bnodeintegration[\"']?\s*[:=]\s*true\b", languages=("JavaScript", "TypeScript")),
    Rule("VC-CFG-003", "Context isolation is off in a renderer", "CodeSafety", HIGH, HIGH, r"(?mdi)\bcontextisolation[\"']?\s*[:=]\s*false\b", languages=("JavaScript", "TypeScript")),
    Rule("VC-CFG-004", "Any origin may send credentials", "Network", HIGH, MEDIUM, r"(?mdi)(?:\borigin[\"']?\s*:\s*(?:[\"']\*[\"']|true\b)|access-control-allow-origin[\"']?\s*[,:]\s*[\"']?\*|allowanyorigin\s*\()[\s\S]{0,200}?(?:credentials[\"']?\s*[,:]\s*[\"']?true|allowcredentials\s*\()|(?:credentials[\"']?\s*[,:]\s*[\"']?true|allowcredentials\s*\()[\s\S]{0,200}?(?:\borigin[\"']?\s*:\s*(?:[\"']\*[\"']|true\b)|access-control-allow-origin[\"']?\s*[,:]\s*[\"']?\*|allowanyorigin\s*\()"),
    Rule("VC-CFG-005", "Certificates are not checked", "Network", HIGH, HIGH, r"(?mdi)\brejectunauthorized[\"']?\s*[:=]\s*false\b|\bnode_tls_reject_unauthorized[\"']?\]?\s*[:=]\s*[\"']?0\b|\bverify\s*=\s*false\b|servercertificate(?:custom)?validationcallback\s*\+?=[^\n]{0,80}?true\b|\binsecureskipverify\s*:\s*true\b|\bcert_none\b|dangerousacceptanyservercertificatevalidator"),
    Rule("VC-CFG-006", "An obsolete TLS version is forced", "Network", MEDIUM, MEDIUM, r"(?md)\bSecurityProtocolType\.(?:Ssl3|Tls|Tls11)\b|\bSslProtocols\.(?:Ssl2|Ssl3|Tls|Tls11)\b|\bPROTOCOL_(?:SSLv2|SSLv3|TLSv1|TLSv1_1)\b|\b(?:min|max)Version[\"']?\s*:\s*[\"']TLSv1(?:\.1)?[\"']"),
    Rule("VC-CFG-007", "An address is called without TLS", "Network", MEDIUM, MEDIUM, r"(?mdi)[\"'`]http://(?!localhost\b|127\.|0\.0\.0\.0|\[::1\]|192\.168\.|10\.)[a-z0-9][a-z0-9.-]*\.[a-z]{2,}[^\s\"'`]*", ("namespace_url", "package_metadata", "comment")),
    Rule("VC-CFG-008", "A service listens on every interface", "Network", HIGH, HIGH, r"(?mdi)(?:\blisten\s*\(|\bbind\s*\(|\bhost[\"']?\s*[:=]|\buseurls\s*\(|\brun\s*\()[^\n]{0,60}?\b0\.0\.0\.0\b|\bipaddress\.any\b"),
    Rule("VC-CFG-009", "Debug mode is on", "CodeSafety", MEDIUM, LOW, r"(?mdi)\bdebug[\"']?\s*[:=]\s*true\b|\bapp\.run\s*\([^\n)]{0,80}?debug\s*=\s*true\b|\bflask_debug\s*=\s*1\b", ("generated", "test_file", "comment")),
    # Code
    Rule("VC-CODE-001", "A query is glued together from values", "CodeSafety", CRITICAL, MEDIUM, rf"(?mdi)[\"'`]\s*{_SQL}[^\n;]{{0,200}}?(?:\$\{{|[\"'`]\s*\+\s*[a-z_]|\{{[a-z_][\w.]*\}}|[\"']\s*%\s*[a-z_(]|\.format\s*\()", ("prose_not_sql",)),
    Rule("VC-CODE-002", "Text is evaluated as code", "CodeSafety", HIGH, HIGH, r"(?md)(?<![\w.$])eval\s*\(\s*(?![\"'`)])[\w$]|\bnew\s+Function\s*\(\s*(?![\"'`)])[\w$]|\bsetTimeout\s*\(\s*[\"'`][^\n]{1,80}?\+", ("comment",)),
    Rule("VC-CODE-003", "A shell command is built from values", "CodeSafety", CRITICAL, HIGH, r"(?md)\b(?:child_process\.)?exec(?:Sync)?\s*\(\s*(?:`[^`\n]{0,200}?\$\{|[\"'][^\"'\n]{0,200}?[\"']\s*\+)|\bos\.system\s*\(\s*(?:f[\"']|[\"'][^\"'\n]{0,200}?[\"']\s*(?:\+|%))|\bsubprocess\.\w+\s*\(\s*f[\"'][^\n]{0,200}?shell\s*=\s*True", ("comment",)),
    Rule("VC-CODE-004", "Untrusted data is deserialised", "CodeSafety", HIGH, HIGH, r"(?md)\bBinaryFormatter\b|\bpickle\.loads?\s*\(|\byaml\.load\s*\((?![^\n)]{0,120}?Safe)|\bTypeNameHandling\.(?:All|Auto|Objects)\b|\bunserialize\s*\(\s*\$_|\bObjectInputStream\s*\(", ("switched_off", "comment")),
    Rule("VC-CODE-005", "A password is hashed by a fast digest", "CodeSafety", HIGH, MEDIUM, rf"(?mdi)(?:{_FAST})[^\n]{{0,80}}?(?:{_PASSWORD})|(?:{_PASSWORD})[^\n]{{0,80}}?(?:{_FAST})", ("comment",)),
    Rule("VC-CODE-006", "A broken cipher", "CodeSafety", MEDIUM, MEDIUM, r"(?mdi)\bciphermode\.ecb\b|\bdescryptoserviceprovider\b|\bcreatecipher\s*\(|[\"']des(?:-[a-z0-9-]+)?[\"']|\bdes/[a-z]+/|\brc4\b|\bdes\b", ("triple", "cipher_in_prose", "enum_member")),
    Rule("VC-CODE-007", "A secret comes from a predictable source", "CodeSafety", HIGH, MEDIUM, r"(?mdi)\b\w*(?:token|secret|nonce|session_?id|password|salt|otp)\w*\s*(?::\s*\w+\s*)?[:=][^\n;]{0,80}?(?:math\.random\s*\(|\brandom\.(?:random|randint|choice)\s*\(|\bnew\s+random\s*\(|\brand\s*\()"),
    Rule("VC-CODE-008", "Archive entries are written where they say", "CodeSafety", HIGH, HIGH, r"(?mdi)path\.(?:combine|join)\s*\([^\n)]{0,80}?\bentry\.?(?:full)?(?:name|path|filename)\b|\bextractall\s*\(\s*(?:path\s*=\s*)?\w*\s*\)"),
    # Untrusted input
    Rule("VC-INPUT-001", "Stack memory sized by a variable", "CodeSafety", HIGH, MEDIUM, r"(?mdi)\bstackalloc\s+\w+\s*\[\s*([a-z_][^\]\n]{0,80}?)\s*\]", ("bounded_size", "comment"), ("CSharp",)),
    Rule("VC-INPUT-002", "An address is opened without a look at its scheme", "Network", MEDIUM, HIGH, r"(?mdi)\bprocess\.start\s*\(\s*(?:new\s+processstartinfo\s*\(\s*)?(?![\"'@$])[a-z_][\w.]*[^\n]{0,80}?useshellexecute\s*=\s*true", ("scheme_checked",), ("CSharp",)),
    Rule("VC-INPUT-003", "A number from outside is parsed unguarded", "CodeSafety", LOW, LOW, r"(?md)\b(?:int|long|double|decimal|float|Int32|Int64)\.Parse\s*\([^\n)]{0,60}?(?:\.Value|GetString\s*\(|\[[\"']|\.Text|args\[)|\bConvert\.ToInt(?:32|64)\s*\([^\n)]{0,60}?(?:\.Value|GetString\s*\(|\[[\"']|args\[)", ("comment",), ("CSharp",)),
    Rule("VC-INPUT-004", "A remote answer is read without a limit", "Network", LOW, LOW, r"(?md)[\w>)\]]\.(?:GetStringAsync|GetByteArrayAsync|ReadAsStringAsync|ReadAsByteArrayAsync|DownloadString|DownloadData)\s*\(", ("bounded_read", "compiler_made", "comment"), ("CSharp",)),
    # Credentials
    Rule("VC-SEC-001", "A private key", "Secrets", CRITICAL, MEDIUM, r"(?md)-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", secret_group=0),
    Rule("VC-SEC-002", "An access key of a cloud account", "Secrets", CRITICAL, MEDIUM, r"(?md)\bAKIA[0-9A-Z]{16}\b", secret_group=0),
    Rule("VC-SEC-003", "A live key of a payment service", "Secrets", CRITICAL, MEDIUM, r"(?md)\b[rs]k_live_[0-9A-Za-z]{16,}\b", secret_group=0),
    Rule("VC-SEC-009", "A password in a connection string", "Secrets", HIGH, MEDIUM, r"(?mdi)\b(?:password|pwd)\s*=\s*([^;\"'\s]{4,80})", ("no_connection", "placeholder", "comment"), secret_group=1),
    Rule("VC-SEC-010", "A credential in the code", "Secrets", HIGH, MEDIUM, r"(?mdi)\b\w*(?:api_?key|apikey|secret|token|passw(?:or)?d|access_?key|auth_?key|client_?secret|private_?key)\w*[\"']?\s*[:=]\s*[\"']([^\"'\n]{8,200})[\"']", ("not_a_secret", "comment"), secret_group=1),
    Rule("VC-SEC-011", "A service key that bypasses row-level security", "Secrets", CRITICAL, HIGH, r"(?md)\beyJ[\w-]{8,}\.([\w-]{8,})\.[\w-]{8,}", ("not_service_role",), secret_group=0),
    Rule("QS-SEC-101", "An access token of a code host", "Secrets", CRITICAL, MEDIUM, r"(?md)\bgh[pousr]_[0-9A-Za-z]{36}\b", secret_group=0),
    Rule("QS-SEC-102", "A token of a chat service", "Secrets", HIGH, MEDIUM, r"(?md)\bxox[abprs]-[0-9A-Za-z-]{10,}\b", secret_group=0),
)
BY_ID = {r.id: r for r in RULES}
