"""Connection descriptors and the reader options they turn into.

A descriptor never shows its secrets when printed. Drivers and connectors that
are not on the class path are needed only when a reader runs.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class JdbcConnection:
    """A relational database reached through JDBC."""

    name: str
    url: str
    driver: str
    username: str = ""
    password: str = field(default="", repr=False)

    def options(self) -> dict[str, str]:
        options = {"url": self.url, "driver": self.driver}
        if self.username:
            options |= {"user": self.username, "password": self.password}
        return options


# Driver classes and default ports of the providers.
POSTGRES_DRIVER, POSTGRES_PORT = "org.postgresql.Driver", 5432
MYSQL_DRIVER, MYSQL_PORT = "com.mysql.cj.jdbc.Driver", 3306
MARIADB_DRIVER, MARIADB_PORT = "org.mariadb.jdbc.Driver", 3306
COCKROACH_PORT = 26257
DERBY_DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def postgres(name, host, database, username="", password="", port=POSTGRES_PORT) -> JdbcConnection:
    """S1."""
    return JdbcConnection(name, f"jdbc:postgresql://{host}:{port}/{database}", POSTGRES_DRIVER, username, password)


def mysql(name, host, database, username="", password="", port=MYSQL_PORT) -> JdbcConnection:
    """S1a."""
    return JdbcConnection(name, f"jdbc:mysql://{host}:{port}/{database}", MYSQL_DRIVER, username, password)


def mariadb(name, host, database, username="", password="", port=MARIADB_PORT) -> JdbcConnection:
    """S1b."""
    return JdbcConnection(name, f"jdbc:mariadb://{host}:{port}/{database}", MARIADB_DRIVER, username, password)


def cockroachdb(name, host, database, cluster, username="", password="", port=COCKROACH_PORT) -> JdbcConnection:
    """Speaks the Postgres protocol; the cluster is an option in the URL."""
    url = f"jdbc:postgresql://{host}:{port}/{database}?options=--cluster%3D{cluster}"
    return JdbcConnection(name, url, POSTGRES_DRIVER, username, password)


def derby_memory(name: str, database: str) -> JdbcConnection:
    """An in-memory database inside the session's own process, for tests."""
    return JdbcConnection(name, f"jdbc:derby:memory:{database};create=true", DERBY_DRIVER)


@dataclass(frozen=True)
class CassandraConnection:
    """A Cassandra cluster: ``host:port`` contact points and a datacenter."""

    name: str
    datacenter: str
    contact_points: tuple[str, ...]
    username: str = ""
    password: str = field(default="", repr=False)

    def options(self, keyspace: str, table: str) -> dict[str, str]:
        options = {
            "keyspace": keyspace,
            "table": table,
            "spark.cassandra.connection.host": ",".join(self.contact_points),
            "spark.cassandra.connection.localDC": self.datacenter,
        }
        if self.username.strip():
            options |= {"spark.cassandra.auth.username": self.username, "spark.cassandra.auth.password": self.password}
        return options


@dataclass(frozen=True)
class ObjectStoreConnection:
    """A bucket of an S3 object store."""

    name: str
    bucket: str
    region: str
    access_key: str = field(default="", repr=False)
    secret_key: str = field(default="", repr=False)

    def path(self, prefix: str = "") -> str:
        return f"s3a://{self.bucket}/{prefix}"

    def hadoop_options(self) -> dict[str, str]:
        """Settings for this bucket only."""
        base = f"fs.s3a.bucket.{self.bucket}"
        options = {f"{base}.endpoint.region": self.region}
        if self.access_key:
            options |= {f"{base}.access.key": self.access_key, f"{base}.secret.key": self.secret_key}
        return options
