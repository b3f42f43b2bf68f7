"""Fixed dimensions of the scanner: languages, severities, rules and the rule terms.

Every table here has a fixed number of rows (the largest has 92), so broadcasting one is safe
whatever the size of the scanned corpus. Users pass their own rows to the functions that build
the DataFrames; `plans.rules` checks the size of those before it broadcasts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PYTHON = "python"
JAVA = "java"
JAVASCRIPT = "javascript"

# Language name and file suffix.
LANGUAGES = [
    (PYTHON, ".py"),
    (JAVA, ".java"),
    (JAVASCRIPT, ".js"),
]

# Severities in report order.
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]

GEN001 = "GEN001"
GEN002 = "GEN002"
GEN003 = "GEN003"

# Fixed value: shortest string that counts as a secret.
MINIMUM_SECRET_LENGTH = 6

# Variable names that usually hold credentials (compared in lower case).
CREDENTIAL_NAMES = [
    "password", "passwd", "pwd", "passphrase",
    "secret", "client_secret", "clientsecret", "app_secret", "application_secret", "shared_secret",
    "token", "access_token", "refresh_token", "id_token", "auth_token", "session_token",
    "oauth_token", "jwt", "bearer",
    "api_key", "apikey", "api_secret", "access_key", "secret_key", "consumer_key",
    "consumer_secret",
    "aws_access_key", "aws_secret_key", "aws_secret_access_key", "aws_session_token",
    "azure_key", "gcp_key",
    "private_key", "privatekey", "public_key", "ssh_key", "ssh_private_key", "pem",
    "keystore", "truststore",
    "db_password", "db_pass", "db_user", "db_username", "connection_string",
    "db_connection_string", "jdbc_url",
    "credential", "credentials", "username", "user", "login",
    "key", "master_key", "encryption_key", "signing_key", "license_key",
]

# Fixed values: (qualifier, name) of functions that run code built at run time.
# A None qualifier matches the name under every qualifier.
UNSAFE_CODE_EXECUTION_FUNCTIONS = [
    ("builtins", "eval"),
    ("builtins", "exec"),
    ("builtins", "compile"),
    ("ScriptEngine", "eval"),
    ("ScriptEngine", "compile"),
    ("CompiledScript", "eval"),
    ("global", "eval"),
    ("window", "eval"),
    ("vm", "runInThisContext"),
    ("vm", "runInContext"),
    ("vm", "runInNewContext"),
    ("vm", "compileFunction"),
    (None, "eval"),
    (None, "compile"),
    (None, "Function"),
    (None, "runInThisContext"),
    (None, "runInContext"),
    (None, "runInNewContext"),
    (None, "compileFunction"),
]

# Fixed values: (qualifier, name) of functions that start operating system commands.
COMMAND_EXECUTION_FUNCTIONS = [
    ("os", "system"),
    ("os", "popen"),
    ("subprocess", "run"),
    ("subprocess", "Popen"),
    ("Runtime", "exec"),
    ("Runtime", "getRuntime"),
    ("ProcessBuilder", "start"),
    ("child_process", "exec"),
    ("child_process", "execSync"),
    ("child_process", "spawn"),
    ("node:child_process", "exec"),
    ("node:child_process", "spawn"),
    (None, "exec"),
    (None, "execSync"),
    (None, "spawn"),
    (None, "Popen"),
]


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LANGUAGES, "language string, extension string")


def severities(spark: SparkSession) -> DataFrame:
    rows = [(name, rank) for rank, name in enumerate(SEVERITIES, start=1)]
    return spark.createDataFrame(rows, "severity string, rank int")


def credential_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name,) for name in CREDENTIAL_NAMES], "name string")


def function_catalogue(spark: SparkSession) -> DataFrame:
    rows = [(GEN002, q, n) for q, n in UNSAFE_CODE_EXECUTION_FUNCTIONS]
    rows += [(GEN003, q, n) for q, n in COMMAND_EXECUTION_FUNCTIONS]
    return spark.createDataFrame(rows, "rule_id string, qualifier string, function_name string")
