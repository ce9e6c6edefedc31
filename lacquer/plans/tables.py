"""What the queries share: tables by name, and pieces of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOW_WRITTEN = "CASE WHEN length({0}) <= 4 THEN '****' ELSE left({0}, 2) || '****' || right({0}, 2) END"
#: The names of the standard floor by level.
SECRET_NAMES = """
    password password_confirmation passwd passphrase pgpassword secret client_secret credential credentials private_key privatekey security_key secret_key secret_access_key
    dsn database_dsn redis_url mongodb_uri mongodb_url amqp_url broker_url http_proxy https_proxy all_proxy docker_auth_config
    connection_string database_uri database_url mysql_pwd rediscli_auth sig signature"""
HIGH_NAMES = """
    access_key accesskey api_key apikey x_api_key token access_token refresh_token id_token jwt jwt_token auth_token bearer
    authorization proxy_authorization cookie set_cookie session session_id session_token auth_app_token auth_user_token"""
MEDIUM_NAMES = "access_key_id license_key"
STANDARD_NAMES = " UNION ALL ".join(f"SELECT unnest(string_split('{' '.join(names.split())}', ' ')) AS name, {level} AS level" for names, level in ((SECRET_NAMES, 4), (HIGH_NAMES, 3), (MEDIUM_NAMES, 2)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
