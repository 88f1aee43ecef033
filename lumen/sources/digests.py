"""SHA-256 of whole files, read as streams on the executors.

Spark's own file sources give a file's bytes as one value, which has to fit a task's memory
and can't exceed 2 GiB, and a store that Spark reads is not open to Python workers.  So the
digest is a small JVM function: compiled by the compiler that Spark's code generation uses,
sent to the executors as a jar, once per application.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_CLASS = "lumen.FileSha256"
_SOURCE = """
package lumen;

public class FileSha256 implements org.apache.spark.sql.api.java.UDF1 {
    public Object call(Object name) throws Exception {
        if (name == null) return null;
        org.apache.hadoop.fs.Path path = new org.apache.hadoop.fs.Path((String) name);
        org.apache.hadoop.conf.Configuration conf = org.apache.spark.deploy.SparkHadoopUtil.get().conf();
        java.security.MessageDigest digest = java.security.MessageDigest.getInstance("SHA-256");
        byte[] buffer = new byte[1 << 18];
        java.io.InputStream in = path.getFileSystem(conf).open(path);
        try {
            for (int n = in.read(buffer); n >= 0; n = in.read(buffer)) digest.update(buffer, 0, n);
        } finally {
            in.close();
        }
        byte[] bytes = digest.digest();
        StringBuilder hex = new StringBuilder();
        for (int i = 0; i < bytes.length; i++) {
            hex.append(Character.forDigit((bytes[i] >> 4) & 15, 16)).append(Character.forDigit(bytes[i] & 15, 16));
        }
        return hex.toString();
    }
}
"""
_SHIPPED: set[str] = set()


def _ship_class(spark: SparkSession) -> None:
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(spark._jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
    compiler.cook(_SOURCE)
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="lumen-jar-")), "lumen-files.jar")
    with zipfile.ZipFile(path, "w") as z:
        for name, code in compiler.getBytecodes().items():
            z.writestr(name.replace(".", "/") + ".class", bytes(code))
    spark.sql(f"ADD JAR '{path}'")
    _SHIPPED.add(app)


def file_sha256(spark: SparkSession, path: Column | str) -> Column:
    """Hex SHA-256 of the bytes of the file that a column names, in 256 KB of memory whatever its size."""
    _ship_class(spark)
    session = spark._jsparkSession
    digest = session.sharedState().jarClassLoader().loadClass(_CLASS).newInstance()
    session.udf().register("lumen_file_sha256", digest, session.parseDataType('"string"'))
    return F.call_function("lumen_file_sha256", F.col(path) if isinstance(path, str) else path)
