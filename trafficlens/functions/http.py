"""Column expressions on web requests."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Threat signatures matched on the request path, case-insensitive.
THREAT_PATTERNS = {
    "sqli": r"(?:union\s+select|'?\s*or\s+['\d]|select\s+.*from\s|insert\s+into|"
            r"drop\s+table|update\s+\w+\s+set|;\s*(?:drop|delete|alter)\s)",
    "xss": r"(?:<script|javascript:|on(?:error|load|click|mouseover)\s*=|"
           r"eval\s*\(|document\.(?:cookie|write)|alert\s*\()",
    "path_traversal": r"(?:\.\./|\.\.\\|%2e%2e[%/])",
    "rfi_lfi": r"(?:(?:file|php|zip|data|expect|glob|phar)://|/etc/(?:passwd|shadow)|/proc/self/)",
    "wordpress": r"(?:/wp-(?:admin|login|content|includes|config|cron)|/xmlrpc\.php|/wp-json/wp/)",
    "scanner_probe": r"(?:/\.env|/\.git/|/config\.php|/phpinfo|/server-status|/actuator|"
                     r"/containers/json|/debug/vars|/solr/admin|/_cat/indices|/elmah\.axd|"
                     r"/telescope/requests|/\.well-known/security\.txt)",
    "shell_shock": r"\(\)\s*\{",
    "log4j": r"\$\{(?:jndi|lower|upper|env):",
    "api_abuse": r"(?:/graphql|/api/v\d+/(?:admin|users|tokens|keys)|/oauth/token|"
                 r"/\.well-known/openid)",
    "cve_exploit": r"(?:/cgi-bin/|/shell|/cmd\.php|/c99\.php|/r57\.php|"
                   r"/eval-stdin\.php|/vendor/phpunit)",
}

# User agents of scripted clients, case-insensitive.
BOT_AGENTS = (
    r"(?:python-requests|python-urllib|Go-http-client|java/|curl/|"
    r"wget/|libwww-perl|PHP/|Scrapy|nikto|sqlmap|nmap|masscan|"
    r"zgrab|httpx|nuclei|dirsearch|gobuster|ffuf|wfuzz|"
    r"bot|spider|crawl|scan|attack|exploit|hack)"
)

# Login end points used to recognise credential stuffing.
AUTH_PATHS = ("/login", "/signin", "/auth", "/oauth", "/api/login",
              "/wp-login.php", "/admin/login", "/user/login")


def http_version(raw: Column) -> Column:
    """'1.0', '1.1', '2', '3' or '' from the protocol text of a request."""
    text = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    number = F.substring(text, F.lit(6), F.length(text))
    return (F.when(text.isin("H2", "H2C") | text.isin("HTTP/2.0", "HTTP/2"), "2")
            .when((text == "H3") | text.isin("HTTP/3.0", "HTTP/3"), "3")
            .when(text.startswith("HTTP/"), number)
            .otherwise(""))


def status_group(status: Column) -> Column:
    return F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))


def worth_matching(path: Column) -> Column:
    """Cheap test that lets plain short paths skip the signatures."""
    return (F.length(path) > 6) | path.rlike(r"['.$<(]") | F.substring(path, F.lit(2), F.length(path)).contains("/")


# The same signatures as searches: characters of which a match holds one at least, and an expression that begins with what
# is rare, so that most places are left at once. Together they find exactly the texts in which THREAT_PATTERNS are found.
THREAT_SEARCHES = {
    "sqli": (((), r"\s(?<=[nrtpe]\s)(?:(?<=or\s)\s*['\d]|(?<=union\s)\s*select|(?<=select\s)\s*.*from\s|(?<=insert\s)\s*into|"
                  r"(?<=drop\s)\s*table|(?<=update\s)\s*\w+\s+set)"),
             ((";",), r";\s*(?:drop|delete|alter)\s")),
    "xss": ((("<",), r"<script"), ((":",), r":(?<=javascript:)"), (("=",), r"on(?:error|load|click|mouseover)\s*="),
            (("(",), r"(?:eval|alert)\s*\("), ((".c", ".C", ".w", ".W"), r"\.(?<=document\.)(?:cookie|write)")),
    "path_traversal": ((("../", "..\\", "%2"), THREAT_PATTERNS["path_traversal"]),),
    "rfi_lfi": ((("://",), r":(?:(?<=file:)|(?<=php:)|(?<=zip:)|(?<=data:)|(?<=expect:)|(?<=glob:)|(?<=phar:))//"),
                (("/",), r"/(?:etc/(?:passwd|shadow)|proc/self/)")),
    "wordpress": ((("/",), r"/(?:wp-(?:admin|login|content|includes|config|cron)|xmlrpc\.php|wp-json/wp/)"),),
    "scanner_probe": ((("/",), r"/(?:\.env|\.git/|config\.php|phpinfo|server-status|actuator|containers/json|debug/vars|solr/admin|"
                               r"_cat/indices|elmah\.axd|telescope/requests|\.well-known/security\.txt)"),),
    "shell_shock": ((("()",), THREAT_PATTERNS["shell_shock"]),),
    "log4j": ((("${",), THREAT_PATTERNS["log4j"]),),
    "api_abuse": ((("/",), r"/(?:graphql|api/v\d+/(?:admin|users|tokens|keys)|oauth/token|\.well-known/openid)"),),
    "cve_exploit": ((("/",), r"/(?:cgi-bin/|shell|cmd\.php|c99\.php|r57\.php|eval-stdin\.php|vendor/phpunit)"),),
}


def _found(path: Column, name: str) -> Column:
    def search(needed: tuple[str, ...], pattern: str) -> Column:
        match = F.rlike(path, F.lit("(?i)" + pattern))
        return reduce(or_, [path.contains(text) for text in needed]) & match if needed else match

    return reduce(or_, [search(*s) for s in THREAT_SEARCHES[name]])


def threat_flags(path: Column) -> Column:
    """Names of the signatures found in the path."""
    hits = [F.when(_found(path, name), F.lit(name)) for name in THREAT_PATTERNS]
    return (F.when(worth_matching(path), F.filter(F.array(*hits), lambda name: name.isNotNull()))
            .otherwise(F.array().cast("array<string>")))


def is_bot_agent(agent: Column) -> Column:
    return F.rlike(F.coalesce(agent, F.lit("")), F.lit("(?i)" + BOT_AGENTS))
