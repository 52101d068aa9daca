"""Stream jobs over Kafka-shaped event logs."""
