"""fleetspark: fleet-telemetry analytics as composable ``DataFrame -> DataFrame`` transforms."""
