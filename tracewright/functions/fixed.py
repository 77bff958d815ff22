"""Thresholds, weights and patterns that results depend on."""

#: Characters of an entropy window and its step; bounds of high and low entropy.
WINDOW, STEP, HIGH, LOW = 256, 128, 5.5, 3.0

#: (pattern, weight) of each programming language, in order of precedence on ties.
LANGUAGES = {
    "javascript": [
        (r"\bfunction\s+\w+\s*\(", 2.0), (r"\bconst\s+\w+\s*=", 1.5), (r"\blet\s+\w+\s*=", 1.5), (r"\bvar\s+\w+\s*=", 2.0),
        (r"=>\s*\{", 2.0), (r"\bconsole\.log\b", 3.0), (r"\bdocument\.\w+", 3.0), (r"\bwindow\.\w+", 3.0), (r"\brequire\s*\(", 2.5),
        (r"\bmodule\.exports\b", 3.0), (r"\bimport\s+\{", 1.5), (r"\bexport\s+(?:default\s+)?(?:function|class|const)", 2.0),
        (r"===", 2.5), (r"!==", 2.5), (r"\bnew\s+Promise\b", 2.0), (r"\.then\s*\(", 1.0), (r"\basync\s+function\b", 2.0),
        (r"\bawait\s+", 1.0), (r"`[^`]*\$\{", 2.0), (r"\btypeof\s+", 2.0), (r"\bundefined\b", 1.5), (r"(?m);\s*$", 0.5),
        (r":\s*(?:string|number|boolean|any|void)\b", 2.5), (r"\binterface\s+\w+\s*\{", 2.0), (r"<\w+>", 0.5),
    ],
    "python": [
        (r"(?m)^def\s+\w+\s*\(", 3.0), (r"(?m)^class\s+\w+.*:", 2.5), (r"(?m)^import\s+\w+", 2.0), (r"(?m)^from\s+\w+\s+import\b", 3.0),
        (r"\bself\.\w+", 3.0), (r"\bprint\s*\(", 1.5), (r"(?m)^if\s+.+:", 1.5), (r"(?m)^for\s+\w+\s+in\s+", 2.5), (r"(?m)^while\s+.+:", 1.0),
        (r"\bTrue\b", 1.5), (r"\bFalse\b", 1.5), (r"\bNone\b", 2.0), (r"\belif\b", 3.0), (r"\bexcept\b", 2.0), (r"(?m)^#\s*!", 1.0),
        (r"(?mi)^#.*python", 3.0), (r'"""', 2.0), (r"\bif\s+__name__\s*==", 5.0), (r"\blambda\s+", 1.5), (r"\bwith\s+\w+.*as\s+\w+:", 2.5),
        (r"\b@\w+", 1.0), (r"(?m)^\s{4}", 0.3),
    ],
    "powershell": [
        (r"\$\w+\s*=", 2.0), (r"(?i)\bfunction\s+\w+\s*\{", 1.5), (r"(?i)\bparam\s*\(", 3.0), (r"(?i)\bWrite-(?:Host|Output|Error)\b", 3.0),
        (r"(?i)\bGet-\w+", 2.5), (r"(?i)\bSet-\w+", 2.5), (r"(?i)\bNew-\w+", 2.5), (r"(?i)\bInvoke-\w+", 3.0),
        (r"(?i)\b-(?:eq|ne|lt|gt|le|ge|like|match|contains)\b", 3.0), (r"(?i)\b-(?:and|or|not)\b", 2.0),
        (r"(?i)\|\s*(?:Where-Object|ForEach-Object|Select-Object)", 3.0), (r"\|\s*%\s*\{", 2.0), (r"\|\s*\?\s*\{", 2.0),
        (r"(?i)\[(?:string|int|bool|array|hashtable)\]", 2.5), (r"(?i)\[System\.\w+\]", 3.0), (r"::", 1.5),
        (r"(?is)\bbegin\b.*\bprocess\b.*\bend\b", 3.0), (r"(?i)#\s*requires\s+-", 3.0), (r"(?i)\bcmdletbinding\b", 4.0), (r"(?i)-(?:replace|split|join)\b", 1.5),
    ],
    "csharp": [
        (r"\busing\s+System", 4.0), (r"\bnamespace\s+\w+", 3.0), (r"\bpublic\s+(?:class|static|void|int|string)\b", 3.0),
        (r"\bprivate\s+(?:class|static|void|int|string)\b", 2.5), (r"\bstatic\s+void\s+Main\b", 5.0), (r"\bConsole\.Write(?:Line)?\b", 3.0),
        (r"\bnew\s+\w+\s*\(", 1.0), (r"\bvar\s+\w+\s*=\s*new\b", 2.0), (r"\bstring\[\]\b", 2.5), (r"\bint\[\]\b", 2.0), (r"\basync\s+Task\b", 3.0),
        (r"\bList<\w+>", 2.5), (r"\bDictionary<\w+,\s*\w+>", 3.0), (r"\bforeach\s*\(", 2.0), (r"\bcatch\s*\(\s*\w+Exception", 2.5),
        (r"///<summary>", 2.0), (r"\[Serializable\]", 2.5), (r"\bget\s*;\s*set\s*;", 3.0), (r"\bstring\.(?:Format|IsNullOrEmpty|Concat)\b", 2.0),
    ],
}

#: Indicators in order: (type, pattern with the value as group 1, whether it is defanged).
INDICATORS = [
    ("ipv4", r"\b((?:25[0-5]|2[0-4]\d|1?\d\d?)(?:\.(?:25[0-5]|2[0-4]\d|1?\d\d?)){3})\b", False),
    ("ipv4", r"\b(\d{1,3}\s*[\[\(]\.[\]\)]\s*\d{1,3}\s*[\[\(]\.[\]\)]\s*\d{1,3}\s*[\[\(]\.[\]\)]\s*\d{1,3})\b", True),
    ("ipv6", r"\b((?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4})\b", False),
    ("url", r"(?i)((?:https?|ftp)://[^\s\"'<>(){}\[\]|\\^`,;]{4,})", False),
    ("url", r"(?i)(hxxps?://[^\s\"'<>(){}\[\]|\\^`,;]{4,})", True),
    ("url", r"(?i)(https?\[:\]//[^\s\"'<>(){}\[\]|\\^`,;]{4,})", True),
    ("domain", r"(?i)\b([a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*\.(?:com|net|org|info|io|co|me|xyz|top|biz|ru|cn|tk|ml|ga|cf|gq|pw|onion|bit|cc|ws|su|de|uk|fr|it|br|in|au|ca|nl|pl|es|cz|edu|gov|mil|int))\b", False),
    ("domain", r"(?i)\b([a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\s*[\[\(]\.[\]\)]\s*[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)+\s*[\[\(]\.[\]\)]\s*(?:com|net|org|info|io|co|me|xyz|top|biz|ru|cn|tk|onion|edu|gov))\b", True),
    ("email", r"\b([a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)\b", False),
    ("email", r"(?i)\b([a-zA-Z0-9_.+-]+\s*[\[\(](?:@|at)[\]\)]\s*[a-zA-Z0-9-]+\s*[\[\(](?:\.|dot)[\]\)]\s*[a-zA-Z0-9-.]+)\b", True),
    ("windows_path", r"([A-Za-z]:\\(?:[^\s\\:*?\"<>|]+\\)*[^\s\\:*?\"<>|]*)", False),
    ("unc_path", r"(\\\\[^\s\\:*?\"<>|]+(?:\\[^\s\\:*?\"<>|]+)*)", False),
]
#: Hashes: (type, digits); at least one letter a-f.
HASHES = [("sha256", 64), ("sha1", 40), ("md5", 32)]
#: Replacements that undo defanging, in order.
REFANG = [(r"\[\.?\]", "."), (r"\(\.?\)", "."), (r"\[:\]", ":"), (r"(?i)\[at\]", "@"), (r"(?i)\(at\)", "@"), (r"(?i)\[dot\]", "."), (r"(?i)\(dot\)", "."), (r"(?i)^hxxp", "http"), (" ", "")]

#: Residual markers: (languages or all, pattern, weight).
JS, PY, PS = ("javascript", "js", "jsx", "typescript", "ts", "tsx"), ("python", "py"), ("powershell", "ps1", "ps")
RESIDUAL = [
    ((), r"(?i)[A-Za-z0-9+/]{48,}={0,2}", 0.4),
    ((), r"""(?:"[^"\n]*"|'[^'\n]*')\s*\+\s*(?:"[^"\n]*"|'[^'\n]*')""", 0.7),
    (JS, r"""\b\w+\s*\(\s*['"]0x[0-9a-fA-F]+['"]\s*\)""", 1.4), (JS, r"(?i)\[\s*(?:0x[0-9a-fA-F]+|\d+)\s*\]", 0.7), (JS, r"(?i)\batob\s*\(", 0.9),
    (JS, r"(?i)\b(?:eval|Function|setTimeout|setInterval)\s*\(", 1.1), (JS, r"(?i)\bString\.fromCharCode\s*\(", 0.9),
    (PY, r"(?i)\bexec\s*\(", 1.2), (PY, r"(?i)\bcompile\s*\(", 0.7), (PY, r"(?i)(?:base64\.)?b64decode\s*\(", 1.0), (PY, r"(?i)\bzlib\.decompress\s*\(", 0.9),
    (PY, r"(?i)\bmarshal\.loads\s*\(", 1.2), (PY, r"(?i)\bcodecs\.decode\s*\(", 0.6),
    (PS, r"(?i)\b(?:Invoke-Expression|IEX)\b", 1.2), (PS, r"(?i)(?:\[System\.Convert\]::|\[Convert\]::|Convert\.)FromBase64String\s*\(", 1.0),
    (PS, r"(?i)\[System\.Text\.Encoding\]::(?:Unicode|UTF8)\.GetString\s*\(", 0.9), (PS, r"(?i)`[A-Za-z]", 0.5), (PS, r"(?i)\bNew-Object\b", 0.4),
]
COMMENT_STARTS = ("#", "//", "/*", "<!--", "<#", "REM ")

# Generic obfuscation techniques, name and pattern, in the order in which they are reported.
TECHNIQUES = [
    ("base64_encoding", r"(?i)(?:atob\s*\(|b64decode\s*\(|FromBase64String\s*\(|[A-Za-z0-9+/]{20,}={0,2})"),
    ("hex_encoding", r"(?:\\x[0-9a-fA-F]{2}){4,}|(?:0x[0-9a-fA-F]{2}\s*,?\s*){4,}|(?:[0-9a-fA-F]{2}){16,}"),
    ("char_code_construction", r"(?i)(?:String\.fromCharCode|\bchr\s*\(|\bChr\s*\(|\[char\]\s*)"),
    ("string_concatenation", r"""(?:["'][^"'\\]{0,8}["']\s*(?:\+|&|\.)\s*){3,}"""),
    ("eval_exec", r"(?i)\b(?:eval|exec|Invoke-Expression|IEX|Execute|ExecuteGlobal)\s*[\(]"),
    ("variable_renaming", r"\b(?:_0x[a-fA-F0-9]{4,}|[Il]{6,}|_[A-Za-z0-9]{1,4})\b"),
    ("array_indexing", r"(?i)\b\w+\s*\[\s*(?:0x[0-9a-fA-F]+|\d+)\s*\]"),
    ("xor_encryption", r"(?i)(?:\^|\bxor\b|-bxor\b)"),
    ("dean_edwards_packer", r"(?i)eval\s*\(\s*function\s*\(\s*p\s*,\s*a\s*,\s*c\s*,\s*k\s*,\s*e\s*,\s*[dr]\s*\)"),
    ("control_flow_flattening", r"(?i)(?:while\s*\(\s*(?:true|!0|1)\s*\)\s*\{?\s*switch|for\s*\(\s*;\s*;\s*\)\s*\{?\s*switch)"),
    ("junk_code", r"(?i)(?:if\s*\(\s*false\s*\)|if\s*\(\s*0\s*\)|if\s*\(\s*!\s*1\s*\)|\bpass\b|void\s*\(?\s*0\s*\)?)"),
    ("reflection", r"(?i)(?:GetType|GetMethod|Reflection|Assembly\.Load|Type\.GetMethod|Activator\.CreateInstance|\[scriptblock\]::Create|getattr\s*\()"),
    ("string_encryption", r"(?i)(?:decrypt|decipher|decode|unscramble)\s*\("),
    ("powershell_encoded_command", r"(?i)-(?:EncodedCommand|enc)\s+[A-Za-z0-9+/=]{20,}"),
    ("python_serialization", r"(?i)(?:pickle|marshal)\.loads\s*\(|zlib\.decompress\s*\("),
]

# Dangerous calls by language, (name, severity, pattern of the call), in the order that breaks ties of severity.
# ARG is the argument of a call: brackets in it may be nested twice.
ARG = r"\(\s*([^()]*(?:\([^()]*(?:\([^()]*\)[^()]*)*\)[^()]*)*)\)"
SINKS = {
    "javascript": [
        ("eval", "high", r"\beval\s*" + ARG),
        ("Function", "high", r"\bnew\s+Function\s*" + ARG),
        ("Function_call", "high", r"\bFunction\s*" + ARG),
        ("setTimeout_string", "medium", r"\bsetTimeout\s*\(\s*(['\"](?:[^'\"\\]|\\.)*['\"])\s*,"),
        ("setInterval_string", "medium", r"\bsetInterval\s*\(\s*(['\"](?:[^'\"\\]|\\.)*['\"])\s*,"),
        ("document_write", "medium", r"\bdocument\.write(?:ln)?\s*" + ARG),
        ("innerHTML", "medium", r"\.innerHTML\s*=\s*([^\n;]+)"),
    ],
    "python": [
        ("eval", "high", r"\beval\s*" + ARG),
        ("exec", "high", r"\bexec\s*" + ARG),
        ("compile", "medium", r"\bcompile\s*" + ARG),
        ("__import__", "medium", r"\b__import__\s*" + ARG),
        ("os_system", "high", r"\bos\.system\s*" + ARG),
        ("subprocess", "high", r"\bsubprocess\.(?:call|run|Popen|check_output)\s*" + ARG),
        ("getattr", "low", r"\bgetattr\s*" + ARG),
    ],
    "powershell": [
        ("Invoke-Expression", "high", r"(?i)\b(?:Invoke-Expression|iex)\s+([^\n|;]+)"),
        ("IEX_pipe", "high", r"(?i)(\|\s*(?:Invoke-Expression|iex)\b)"),
        ("Invoke_method", "high", r"\.Invoke\s*" + ARG),
        ("ScriptBlock_Create", "high", r"(?i)\[ScriptBlock\]::Create\s*" + ARG),
        ("EncodedCommand", "high", r"(?i)-(?:EncodedCommand|enc)\s+([^\s;|]+)"),
        ("DownloadString", "high", r"(?i)\.DownloadString\s*" + ARG),
        ("Start-Process", "medium", r"(?i)\bStart-Process\s+([^\n|;]+)"),
    ],
    "csharp": [
        ("Assembly_Load", "high", r"\bAssembly\.Load(?:From|File)?\s*" + ARG),
        ("Activator_CreateInstance", "high", r"\bActivator\.CreateInstance\s*" + ARG),
        ("Process_Start", "high", r"\bProcess\.Start\s*" + ARG),
        ("Invoke_Member", "high", r"\.InvokeMember\s*" + ARG),
        ("DynamicInvoke", "high", r"\.DynamicInvoke\s*" + ARG),
        ("CompileAssemblyFromSource", "high", r"\.CompileAssemblyFromSource\s*" + ARG),
    ],
}
